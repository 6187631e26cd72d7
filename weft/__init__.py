"""weft: a Spark-first engine for graph, temporal, rule and table analytics."""
