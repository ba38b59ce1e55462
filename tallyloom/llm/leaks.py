"""Evaluation passages that leaked into a corpus, by a stored positional inverted index.

Texts are reduced to their letters and digits (compatibility form, case folded).  A token is
ten consecutive letters, as many scripts have no blanks.  The index holds postings (term,
document, position) of every document, whatever will be asked: of each eleven consecutive
tokens the one of least hash, so any common run of twenty letters has a posting in
common, about a sixth of all positions.  It is written once and answers any set of passages.

A passage is looked up from its rarest terms: a document that holds the asked share must have a
certain number of its terms, so it has one of the rarest others.  What is
found so is looked up by the passage's other terms, and only documents with enough terms are read again to verify
exact phrases and proximity, letter by letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.tables import materialize, release, spread

#: Letters of a term.
TERM = 10
#: Letters that a common run must have.
RUN = 20
#: Distinct terms of a query set up to which they are sent to all workers, at most some 50 MB; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Letters and digits of a text in compatibility form, case folded; null gives the empty text."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(filter(str.isalnum, text))


def term_hashes(plain: str, size: int = TERM) -> np.ndarray:
    """64-bit hash of the ``size`` letters at each position of a text of letters, empty for short ones."""
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * _BASE + codes[j : j + n] + np.uint64(1)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash, the first of equals, in each ``window`` consecutive ones; none for fewer."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def build_index(docs: DataFrame, doc_id: str, text: str, run: int = RUN) -> DataFrame:
    """The positional index ``doc BIGINT, term BIGINT, pos INT`` of all documents, written to the shared folder.

    Null ids and texts, and texts with fewer than ``run`` letters, have no posting; repeated rows repeat theirs.
    Extra columns are ignored.  No shuffle.
    """
    window = _window(run)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, terms, places = [], [], []
            for doc, body in zip(batch["doc"], batch["text"], strict=True):
                hashes = term_hashes(letters(body))
                at = chosen(hashes, window)
                ids.append(np.full(len(at), doc, dtype=np.int64))
                terms.append(hashes[at])
                places.append(at.astype(np.int32))
            if ids:
                yield pd.DataFrame({"doc": np.concatenate(ids), "term": np.concatenate(terms), "pos": np.concatenate(places)})

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    return materialize(spread(source, "doc").mapInPandas(index, "doc BIGINT, term BIGINT, pos INT"))


def _window(run: int) -> int:
    if run < 2 * TERM - 1:
        raise ValueError(f"runs shorter than {2 * TERM - 1} letters aren't met by the index")
    return run - TERM + 1


def _passage_terms(items: DataFrame, window: int) -> DataFrame:
    """``item, size, term, at``: the terms of each passage that the index would hold of it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, passage in zip(batch["item"], batch["passage"], strict=True):
                plain = letters(passage)
                hashes = term_hashes(plain)
                rows += [(item, len(plain), int(hashes[at]), int(at)) for at in chosen(hashes, window)]
            yield pd.DataFrame(rows, columns=["item", "size", "term", "at"])

    return items.mapInPandas(cut, "item BIGINT, size INT, term BIGINT, at INT")


def matched(doc: str, passage: str, run: int) -> tuple[int, int, int]:
    """Letters of a passage that a document holds in common runs of at least ``run``, the longest common phrase, and the
    most letters of such runs within any stretch of the document that is twice as long as the passage."""
    there, asked = term_hashes(doc, run), term_hashes(passage, run)
    if not len(there) or not len(asked):
        return 0, 0, 0
    at = np.flatnonzero(np.isin(asked, there))
    if not len(at):
        return 0, 0, 0

    def marks(starts: np.ndarray, n: int) -> np.ndarray:
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + run, -1)
        return np.cumsum(edges[:-1]) > 0

    longest = 0
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        first, end = int(part[0]), int(part[-1]) + run
        while first + max(longest, run - 1) < end:  # runs may come from several places of the document
            last = min(end, first + longest + 1) if longest else first + run
            while last <= end and passage[first:last] in doc:
                longest, last = last - first, last + 1
            first += 1
    sums = np.concatenate(([0], np.cumsum(marks(np.flatnonzero(np.isin(there, asked)), len(doc)))))
    reach = min(2 * len(passage), len(doc))
    return int(marks(at, len(passage)).sum()), longest, int((sums[reach:] - sums[: len(sums) - reach]).max())


def search(index: DataFrame, docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = 0.5, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, letters, of_letters, longest, kind``: documents with at least ``share`` of a passage's letters in runs of ``run``.

    ``longest`` is the longest common phrase.  ``kind`` is ``exact`` for the whole passage as one phrase, ``phrase`` if
    the longest one alone has the share, ``proximity`` if the runs within a stretch of twice the passage's
    length have it, else ``scattered``.

    * Null, empty and blank texts, and passages with fewer than ``run`` letters, give no row.
    * Equal documents or items under several ids each give their rows; repeated rows of one id give one.
    * ``run`` must be that of the index, at least ``2 * TERM - 1``.
    * Extra columns are ignored.  Empty tables give no row.

    Nothing of the passages or documents comes to the driver but the number of distinct terms, and up to
    ``BROADCAST_TERMS`` of these on their way to all workers.
    """
    window = _window(run)
    asked = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(passage).cast("string").alias("passage")).where("item IS NOT NULL AND passage IS NOT NULL").dropDuplicates(["item"])
    asked = materialize(asked)
    terms = materialize(_passage_terms(asked, window))
    wanted = terms.select("term").distinct()
    # The files of postings and pairs are a small part of their rows in memory, and Spark estimates by files: but for the terms,
    # whose number is known, nothing may be broadcast, as that would pass through the driver.
    met = materialize(index.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted.hint("merge"), "term").select("term", "doc", "pos").distinct())

    # Runs that cover a stretch can be thinned to half of it without overlap, and a run of L letters has at least (L - 9) / 11
    # terms of its own, so each term accounts for 60 letters at most: a document needs this many of a passage's terms ...
    longest = 2 * (run + window - 1)
    needed = F.ceil(F.col("size") * F.lit(share) / F.lit(float(longest)))
    # ... and if it lacks all of the rarest, but this many less one, it can't have them.
    rarity = met.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    ranked = terms.join(rarity.hint("merge"), "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "term", "at")))
    placed = materialize(ranked.withColumn("rare", F.col("rank") <= F.count("*").over(Window.partitionBy("item")) - needed + 1).select("item", "size", "term", "at", "rare"))
    first = materialize(placed.where("rare").join(met.hint("merge"), "term").select("doc", "item", "size", "at").distinct())
    # the rest of the terms, a few of each passage, only for what was found by the rarest
    rest = first.select("doc", "item").distinct().join(placed.where("NOT rare").hint("merge"), "item").join(met.hint("merge"), ["doc", "term"]).select("doc", "item", "size", "at")
    enough = first.unionByName(rest).groupBy("doc", "item", "size").agg(F.count_distinct("at").alias("n")).where(F.col("n") >= needed)
    pairs = materialize(enough.join(asked.hint("merge"), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "passage")).alias("pairs")))
    release(met, terms, asked, placed, first)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body, wanted in zip(batch["doc"], batch["text"], batch["pairs"], strict=True):
                whole = letters(body)
                for pair in wanted:
                    plain = letters(pair["passage"])
                    n, phrase, near = matched(whole, plain, run)
                    if n >= share * len(plain):
                        kind = "exact" if phrase == len(plain) else "phrase" if phrase >= share * len(plain) else "proximity" if near >= share * len(plain) else "scattered"
                        out.append((doc, pair["item"], n, len(plain), phrase, kind))
            yield pd.DataFrame(out, columns=["doc", "item", "letters", "of_letters", "longest", "kind"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    found = source.join(pairs.hint("merge"), "doc").mapInPandas(verify, "doc BIGINT, item BIGINT, letters INT, of_letters INT, longest INT, kind STRING")
    return found.dropDuplicates(["doc", "item"]).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "letters", "of_letters", "longest", "kind")


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = 0.5, run: int = RUN) -> DataFrame:
    """:func:`search` with an index of the documents that is only used this once."""
    index = build_index(docs, doc_id, text, run)
    found = search(index, docs, doc_id, text, items, item_id, passage, share, run)
    release(index)
    return found
