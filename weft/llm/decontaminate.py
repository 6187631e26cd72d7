"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. build_index() writes one list for each word
and shard of up to 2^BLOCK_BITS documents, (term, shard, n, places), ordered by the word in each file; a place is the
document's number in its shard and the word's number in it, in one long. Documents are dealt out evenly, once, and their lists
are put together where they went, so no task sorts more than its share; postings are not shuffled. A row without a word heads each document: its id, word count and mark. A word
that a third of the corpus says has a list of its own in every shard, so no list is hot.

phrase_matches() looks test items up. Frequencies come from the lists' lengths alone. In every window of an item its two
rarest terms are anchors; only their lists are opened, and with the place in the item subtracted they meet in diagonals.
Where enough lists meet, the lists of the other terms in that shard are intersected with the places that are asked for, and
runs of consecutive matches as long as a window are returned: exact phrases, of all windows, whatever their number. Items
shorter than a window match as a whole. proximity_matches() opens the lists of an item's two rarest terms one after the
other, and the others only in the shards that are left. Of a list, only places in documents that are asked for are kept before
it meets anything: these documents are one bit each, broadcast by shard, so lists of common words are not shuffled.

What grows with the benchmark is broadcast where its size is checked, in rows and bytes; what grows with the corpus is
shuffled beyond few rows. Null texts have no words. Null ids are ids like others, but a null item id is not counted among
items. Repeated rows are documents of their own. Empty tables on either side give documents without hits, or no rows.
Extra columns are left out by contamination() and kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_az, session_conf, small, table

WINDOW, SLOP = 10, 50
#: What parts words before A-Z are lower-cased.
APART = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Documents of a shard at most, as a number of bits, and bits of a word's number in its document.
BLOCK_BITS, PLACE_BITS = 13, 48
#: Words of an item that are looked at together.
STRETCH = 1000
#: Rows up to which what grows with the benchmark, and with the corpus, is broadcast (and both up to a size in bytes).
MOST_BROADCAST, MOST_FOUND = 400_000, 400_000


def pieces(text: str) -> Column:
    """A text's words, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), APART), "")


def lowered(word: str) -> Column:
    """A-Z lower-cased; lower() does just that where all is ASCII, and much faster."""
    return F.when(F.octet_length(word) == F.char_length(F.col(word)), F.lower(word)).otherwise(lower_az(word))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a written table: (term, shard, head, n, places); a row without a term for each document, with its head."""
    # As many parts as tasks read, more if these have more than half a shard each: each shard has lists of its own.
    n, last = docs.select(F.spark_partition_id().alias("t")).agg(F.count("*"), F.max("t")).first()
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max((last or 0) + 1, -(-n * 2 >> BLOCK_BITS))))
    given = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    # A task's documents are numbered from its number times 2^33. They go round to all parts, so none holds more than its
    # share, and are numbered again there: a shard is of one part.
    part = F.pmod(F.shiftright("row", 33) + F.col("row").bitwiseAND((1 << 33) - 1), F.lit(parts))
    dealt = given.select(part.cast("int").alias("part"), "doc", "text").repartitionById(parts, F.col("part")).withColumn("row", F.monotonically_increasing_id())
    at = F.shiftleft(F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1), PLACE_BITS)
    rows = dealt.select("part", F.shiftright("row", BLOCK_BITS).alias("shard"), at.alias("at"), "doc", F.xxhash64("text").alias("mark"), pieces("text").alias("words"))
    head = F.struct("at", "doc", F.size("words").cast("long").alias("n_words"), "mark")
    placed = rows.select("part", "shard", "at", head.alias("head"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("pos", "word"))
    posted = placed.select("part", "shard", lowered("word").alias("term"), (F.col("at") + F.col("pos")).alias("place"), F.when(F.col("pos") == 0, F.col("head")).alias("head"))
    # Sorted, not hashed: a task has too many words to hold a list of each at a time.
    with session_conf(docs.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        lists = posted.groupBy("term", "shard", "part", "head").agg(F.collect_list("place").alias("places"))
        return table(lists.select("term", "shard", "head", F.size("places").alias("n"), "places"), "index")


def documents_of(index: DataFrame) -> DataFrame:
    """(shard, at, doc, n_words, mark) of every document."""
    return index.filter(F.col("term").isNull()).select("shard", "head.*")


def lists_of(index: DataFrame) -> DataFrame:
    return index.filter(F.col("term").isNotNull()).select("term", "shard", "n", "places")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, id, length, at, term): a test item's words with their places, as a written table."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("id"), pieces(text).alias("w"))
    placed = rows.select("item", "id", F.size("w").alias("length"), F.posexplode("w").alias("at", "word"))
    return table(placed.select("item", "id", "length", "at", lowered("word").alias("term")), "items")


def with_frequency(index: DataFrame, terms: DataFrame) -> DataFrame:
    """terms, a written table, with each term's number of training postings, by its lists' lengths; terms that have none are left out."""
    wanted = broadcast_if_small(terms, MOST_BROADCAST).select("term")
    counted = lists_of(index).select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("frequency"))
    return terms.join(broadcast_if_small(table(counted, "terms"), MOST_BROADCAST), "term")


def anchors(terms: DataFrame, window: int) -> DataFrame:
    """Places of the two rarest terms of every window (one term: of the item), of windows whose terms all occur.

    An item is cut into stretches; the words after a stretch that its last windows reach into are given to it too.
    """
    stretch = max(STRETCH, window)
    own = F.floor(F.col("at") / stretch)
    reach = F.when((F.col("at") % stretch < window - 1) & (F.col("at") >= stretch), F.array(own, own - 1)).otherwise(F.array(own))
    order = Window.partitionBy("item", "stretch").orderBy("at").rowsBetween(0, window - 1)
    spans = terms.withColumn("stretch", F.explode(reach)).withColumn("seen", F.collect_list(F.struct("frequency", "at", "term")).over(order))
    need = F.least(F.lit(window), F.col("length"))
    whole = (own == F.col("stretch")) & (F.size("seen") == need) & (F.element_at("seen", -1)["at"] == F.col("at") + need - 1)
    two = spans.filter(whole).select("item", "length", F.explode(F.slice(F.sort_array("seen"), 1, 2)).alias("a"))
    return two.select("item", "length", F.col("a.at").alias("at"), F.col("a.term").alias("term")).distinct()


def opened(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(columns of terms, shard, place): the postings of the terms of a written table; no other list is opened."""
    met = lists_of(index).join(broadcast_if_small(terms, MOST_BROADCAST), "term")
    return met.select(*terms.columns, "shard", F.explode("places").alias("place"))


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, at, item, id, pos, length): runs of a document's words, from pos, that an item has too; every window of it."""
    terms = table(with_frequency(index, item_terms(items, key, text)), "item-terms")
    met = opened(index, table(anchors(terms, window), "anchors"))
    met = met.select("shard", "item", "length", (F.col("place") - F.col("at")).alias("diagonal"), "at")
    diagonals = met.groupBy("shard", "item", "diagonal").agg(F.count("*").alias("n"), F.first("length").alias("length"), F.min("at").alias("low"), F.max("at").alias("high"))
    diagonals = diagonals.filter(F.col("n") >= F.least(F.lit(2), "length"))
    near = F.col("at").between(F.col("low") - window + 1, F.col("high") + window - 1)
    wanted = diagonals.drop("n", "length").join(broadcast_if_small(terms, MOST_BROADCAST), "item").filter(near)
    wanted = table(wanted.select("shard", "term", (F.col("diagonal") + F.col("at")).alias("place"), "item", "id", "length", "diagonal", "at"), "wanted")
    found = intersected(index, terms, wanted).join(broadcast_if_small(wanted, MOST_FOUND), ["shard", "term", "place"])
    along = Window.partitionBy("shard", "item", "diagonal").orderBy("at")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy("shard", "item", "diagonal", "run")
    runs = runs.agg(F.first("id").alias("id"), F.min("place").alias("place"), F.count("*").cast("int").alias("n"), F.first("length").alias("of"))
    runs = runs.filter(F.col("n") >= F.least(F.lit(window), "of"))
    return runs.select("shard", document_part("place").alias("at"), "item", "id", word_part("place").alias("pos"), F.col("n").alias("length"))


def document_part(place: str) -> Column:
    return F.shiftleft(F.shiftright(place, PLACE_BITS), PLACE_BITS)


def word_part(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << PLACE_BITS) - 1)


def in_documents(lists: DataFrame, asked: DataFrame, place: str) -> DataFrame:
    """lists with only the places that are in a document of a place asked for, of a written table; others are left out."""
    number = F.shiftright(place, PLACE_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    words = asked.groupBy("shard", F.shiftright(number, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    each = F.transform(F.sequence(F.lit(0), F.lit((1 << max(BLOCK_BITS - 6, 0)) - 1)), lambda w: F.coalesce(F.col("words")[w], F.lit(0).cast("long")))
    bits = table(words.select("shard", each.alias("bits")), "asked-bits")
    has = lambda p: F.getbit(F.get("bits", F.shiftright(p, PLACE_BITS + 6).cast("int")), F.shiftright(p, PLACE_BITS).bitwiseAND(63).cast("int")) == 1
    left = lists.join(broadcast_if_small(bits, MOST_FOUND), "shard").withColumn("places", F.filter("places", has))
    return left.filter(F.size("places") > 0).select(*lists.columns)


def intersected(index: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, term, place): places of wanted that a list has; a list is only opened where its shard's is asked for."""
    asked = table(wanted.groupBy("shard", "term").agg(F.collect_set("place").alias("asked")), "asked")
    lists = lists_of(index).select("term", "shard", "places")
    if not small(asked, MOST_FOUND):  # only lists of the items' terms are shuffled, and of them what is in documents asked for
        lists = lists.join(broadcast_if_small(terms, MOST_BROADCAST).select("term"), "term", "left_semi")
        lists = in_documents(lists, wanted, "place")
    met = lists.join(broadcast_if_small(asked, MOST_FOUND), ["term", "shard"])
    return met.select("shard", "term", F.explode(F.array_intersect("places", "asked")).alias("place"))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = SLOP, key: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, at, item, id, pos): places of an item's rarest term that have all its other terms within slop words.

    The rarest is the one with the fewest training postings, of those that tie the least. The list of the second is opened
    next; those of all other terms only where the two met.
    """
    once = table(item_terms(items, key, text).groupBy("item", "id", "term").agg(F.count("*").alias("times")), "near-items")
    known = with_frequency(index, once).withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("frequency", "term")))
    whole = known.groupBy("item").agg(F.count("*").alias("of")).join(once.groupBy("item").agg(F.count("*").alias("of")), ["item", "of"])
    terms = table(known.join(whole, "item").select("item", "id", "term", "nth", "of"), "near-terms")
    wide = slop + 1
    bucket = lambda place: place - place % wide  # noqa: E731  (no division: places need more bits than a double has)
    around = F.explode(F.array(bucket(F.col("p")) - wide, bucket(F.col("p")), bucket(F.col("p")) + wide)).alias("bucket")
    left = opened(index, table(terms.filter("nth = 1"), "near-terms")).select("shard", "item", "id", "of", F.col("place").alias("p"))
    for low, high in (2, 2), (3, 2**31 - 1):
        left = table(left, "near")
        some = broadcast_if_small(table(terms.filter(F.col("nth").between(low, high)).select("item", "term"), "near-terms"), MOST_BROADCAST)
        asking = table(left.select("shard", "item", "id", "of", "p", around), "asking")
        listed = in_documents(lists_of(index).select("term", "shard", "places").join(some.select("term"), "term", "left_semi"), left, "p")
        listed = listed.select("term", "shard", F.explode("places").alias("place")).withColumn("bucket", bucket(F.col("place")))
        met = listed.join(broadcast_if_small(asking, MOST_FOUND), ["shard", "bucket"])
        met = met.filter((F.abs(F.col("place") - F.col("p")) <= slop) & (F.shiftright("place", PLACE_BITS) == F.shiftright("p", PLACE_BITS)))
        met = met.join(some, ["item", "term"], "left_semi")
        per = met.groupBy("shard", "item", "p").agg(F.first("id").alias("id"), F.first("of").alias("of"), F.countDistinct("term").alias("n"))
        done = left.filter(F.col("of") < low)  # items with fewer terms
        left = per.filter(F.col("n") == F.least(F.lit(high), "of") - (low - 1)).select("shard", "item", "id", "of", "p").unionByName(done.select("shard", "item", "id", "of", "p"))
    return left.select("shard", document_part("p").alias("at"), "item", "id", word_part("p").alias("pos"))


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc, mark, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document of the index.

    With slop, also n_near: items that have all their terms near each other in the document, in any order.
    """
    runs = table(phrase_matches(index, items, window), "matches")
    before = Window.partitionBy("shard", "at").orderBy("pos", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("pos", F.coalesce(F.max(end).over(before), F.col("pos"))))
    each = runs.withColumn("fresh", fresh).groupBy("shard", "at").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("ids"))
    near = F.lit(None).cast("long")
    if slop is not None:
        close = proximity_matches(index, items, slop).groupBy("shard", "at").agg(F.countDistinct(F.col("id").cast("string")).alias("n_near"))
        each, near = each.join(close, ["shard", "at"], "full_outer"), F.coalesce("n_near", F.lit(0))
    # A document's place in the index was given when the index was written; hits are few, documents all.
    joined = documents_of(index).join(broadcast_if_small(table(each, "hits"), MOST_FOUND), ["shard", "at"], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = joined.select("doc", "mark", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"), near.alias("n_near"))
    return out if slop is not None else out.drop("n_near")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a window of an item."""
    found = contamination(build_index(docs, key, text), items)
    gone = table(found.filter("contaminated").select(F.col("doc").alias("__found_doc"), F.col("mark").alias("__found_mark")).distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("__found_doc")) & F.xxhash64(text).eqNullSafe(F.col("__found_mark"))
    return docs.join(broadcast_if_small(gone, MOST_FOUND), same, "left_anti")
