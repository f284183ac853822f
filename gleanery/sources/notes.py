"""Release notes as a table function: one payload to many rows, usable from SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gleanery.sources.html import note_entries

NAME = "release_notes"
ENTRY = "pos int, day string, title string, summary string"
# Entries a page, and the least and greatest lengths of their texts.
MOST_ENTRIES, LEAST_TITLE, MOST_TITLE, MOST_SUMMARY = 10, 6, 240, 1000


class ReleaseNotes:
    """The entries of one page of release notes.

    ``body`` is the page (null: no entries); ``kind`` is html, sections or
    bullets; ``most`` bounds the entries of a page.  A page without dates has
    no entries.  A page without entries gives no row, with LEFT JOIN LATERAL too
    (Spark evaluates Python table functions without their outer side).
    """

    def eval(self, body: str, kind: str, most: int = MOST_ENTRIES) -> Iterator[tuple]:
        place = 0
        for day, title, summary in note_entries(body or "", kind):
            if place >= most:
                return
            if len(title) >= LEAST_TITLE:
                yield place, day, title[:MOST_TITLE], summary[:MOST_SUMMARY]
                place += 1


release_notes = udtf(ReleaseNotes, returnType=ENTRY, useArrow=True)


def register(spark: SparkSession, name: str = NAME) -> None:
    """Make the function known to SQL: ``SELECT ... FROM pages, LATERAL release_notes(body, 'html')``."""
    spark.udtf.register(name, release_notes)
