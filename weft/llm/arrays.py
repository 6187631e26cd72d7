"""Sorted arrays in files of the shared folder: those of weft.plans, under the name that this folder uses."""

from weft.plans.arrays import OPEN_FILES, Reader, Writer, firsts, narrow, place, reader_of

__all__ = ["OPEN_FILES", "Reader", "Writer", "firsts", "narrow", "place", "reader_of"]
