"""Substring dedup by repeated-phrase automata.

A run of 20 words that starts earlier too (in a document of smaller doc_id, or before in the same one) is removed.

1. Anchors, phrases of PHRASE_WORDS words chosen by content, are counted over all documents; those that recur confirm
   where passages may recur. No document says more of a phrase than its first two places, so that one which fills
   a document, or all of them, is few rows. Documents with equal words are looked at once: the later ones are removed whole.
2. Documents with recurring phrases are streamed, shard by shard, through an Aho-Corasick automaton (over word numbers)
   of their shard's recurring phrases; it locates every occurrence, those after the second only here, and the runs anchored there are posted by hash.
3. Postings with one run hash give its first start; every other start is sent to its document, whose words
   that such runs cover are removed.

Runs are told apart by 64-bit hashes (of words hashed to 64 bits).

Defined results. Null, empty and blank texts have no words; fewer than 20 words repeat nothing. Rows that repeat a
doc_id with the same words are one document, and each has its result. If rows repeat a doc_id with other words, the least digest
stands for the doc_id and the other rows are left whole. Rows without doc_id take no part and are left whole. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.anchors import anchor_of_runs, classes, first_two, once, recurring, scan
from brightline.llm.common import gram_hashes, mix, word_hashes

RUN_WORDS = 20
PHRASE_WORDS = 8
#: Letters for each digit of a word's number in an automaton.
BASE = 128
#: Phrases that one automaton holds, some tens of MB; a shard's documents are streamed in chunks of that many phrases.
AUTOMATON_PHRASES = 20_000
#: Bytes of texts that a chunk holds beside; a longer text is a chunk by itself.
CHUNK_BYTES = 8 << 20
#: Words of a text that go through the automaton at once.
STEP_WORDS = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def look(text: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Number of words, digest of the words, the first two places of each anchor phrase and their hashes."""
    words = words_of(text)
    grams = gram_hashes(word_hashes(np.frombuffer(text, np.uint8)), PHRASE_WORDS)
    at = anchor_of_runs(grams, RUN_WORDS, PHRASE_WORDS)  # never falls from one run to the next
    at = at[np.diff(at, prepend=-1) > 0]
    at = first_two(at, grams[at])
    return len(words), hashlib.sha256(b" ".join(words)).digest(), at, grams[at]


def digits(number: int) -> str:
    """A word's number as three letters, each place of digits with letters of its own, so that nothing matches across words."""
    return chr(number % BASE) + chr(BASE + number // BASE % BASE) + chr(2 * BASE + number // BASE**2)


def phrase_automaton(texts: list[tuple[list[bytes], list[int]]]) -> tuple[ahocorasick.Automaton, dict[bytes, str]]:
    """An automaton of the phrases that start at the given places, and the numbers (from 1) of their words.

    It searches the children of a node one after the other: with digits for letters, none has more than BASE or so, not even the root.
    """
    numbers: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words, places in texts:
        for at in places:
            automaton.add_word("".join([numbers.get(w) or numbers.setdefault(w, digits(len(numbers) + 1)) for w in words[at : at + PHRASE_WORDS]]))
    automaton.make_automaton()
    return automaton, numbers


def located(words: list[bytes], automaton: ahocorasick.Automaton, numbers: dict[bytes, str]) -> np.ndarray:
    """For each place, whether a recurring phrase starts there."""
    found = np.zeros(len(words) + 1, bool)
    get, unknown = numbers.get, digits(0)
    for a in range(0, len(words), STEP_WORDS):
        said = "".join([get(w, unknown) for w in words[a : a + STEP_WORDS + PHRASE_WORDS - 1]])
        ends = np.fromiter((end for end, _ in automaton.iter(said)), np.int64)
        found[a + (ends + 1) // 3 - PHRASE_WORDS] = True
    return found


def run_hashes(phrases: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN_WORDS words at starts, of the hashes of the phrases that cover each of them."""
    out = np.zeros(len(starts), np.uint64)
    for at in (*range(0, RUN_WORDS - PHRASE_WORDS, PHRASE_WORDS), RUN_WORDS - PHRASE_WORDS):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + phrases[starts + at])
    return out


def posted_runs(texts: DataFrame) -> DataFrame:
    """run (hash), doc_id and start of every run whose anchor is a recurring phrase. texts: doc_id, text, sha, at."""

    def flush(chunk: list[tuple[int, bytes, list[bytes], list[int]]]) -> pa.RecordBatch:
        automaton, numbers = phrase_automaton([(words, places) for _, _, words, places in chunk])
        runs, ids, starts = [], [], []
        for doc_id, text, words, _ in chunk:
            hashes = word_hashes(np.frombuffer(text, np.uint8))
            phrases = gram_hashes(hashes, PHRASE_WORDS)
            hit = np.flatnonzero(located(words, automaton, numbers)[anchor_of_runs(phrases, RUN_WORDS, PHRASE_WORDS)])
            runs.append(run_hashes(phrases, hit).view(np.int64))
            ids.append(np.full(len(hit), doc_id))
            starts.append(hit.astype(np.int32))
        columns = [pa.array(np.concatenate(x)) for x in (runs, ids, starts)]
        return pa.RecordBatch.from_arrays(columns, names=["run", "doc_id", "start"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, phrases, size = [], 0, 0
        for batch in batches:
            for doc_id, text, sha, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sha", "at")), strict=True):
                words = words_of(text)
                if hashlib.sha256(b" ".join(words)).digest() != sha:
                    continue
                chunk.append((doc_id, text, words, at))
                phrases, size = phrases + len(at), size + len(text)
                if phrases >= AUTOMATON_PHRASES or size >= CHUNK_BYTES:
                    yield flush(chunk)
                    chunk, phrases, size = [], 0, 0
        if chunk:
            yield flush(chunk)

    return texts.select("doc_id", F.col("text").cast("binary").alias("text"), "sha", "at").mapInArrow(stream, "run long, doc_id long, start int")


def later_starts(runs: DataFrame) -> DataFrame:
    """doc_id and starts: the sorted starts of runs that start earlier too."""
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that both sides of the join are plain shuffles and Spark can split a run that very many documents hold.
    first = materialise(first.select("run", "first"), "first")
    later = runs.join(first, "run").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def without_runs(texts: DataFrame) -> DataFrame:
    """doc_id, n_removed, text and kept_sha256 of texts (doc_id, text, starts) without the words that runs at starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, shas, wholes = [], [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = words_of(text)
                edges = np.zeros(len(words) + RUN_WORDS + 1, np.int64)
                starts = np.array([s for s in starts if s + RUN_WORDS <= len(words)], np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + RUN_WORDS, -1)
                covered = np.cumsum(edges)[: len(words)] > 0
                left = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                removed.append(int(covered.sum()))
                kept.append(left.decode("utf-8", "replace"))
                shas.append(hashlib.sha256(left).hexdigest())
                wholes.append(hashlib.sha256(b" ".join(words)).digest())
            columns = [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string()), pa.array(wholes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_removed", "kept", "kept_sha256", "sha"])

    columns = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "starts")
    return columns.mapInArrow(run, "doc_id long, n_removed long, kept string, kept_sha256 string, sha binary")


def dedup_phrases(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_words, n_removed and kept_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = scan(docs, look, "phrases")
    one = materialise(classes(scanned), "classes")
    again = recurring(scanned, one)
    wide, scanned = scanned, materialise(scanned.select("doc_id", "sha", "size"), "sizes")
    discard(wide)
    runs = materialise(posted_runs(once(texts, scanned).join(again, "doc_id")), "runs")
    discard(again)
    later = materialise(later_starts(runs), "later")
    discard(runs)
    cut = without_runs(texts.join(later, "doc_id")).drop("kept")
    rows = scanned.select("doc_id", "sha", F.col("size").alias("n_words"))
    mine = scanned.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("sha"))
    mine = mine.join(one.select("sha", "first_id"), "sha").select("doc_id", "sha", (F.col("doc_id") > F.col("first_id")).alias("copy"))
    state = mine.join(cut.select("doc_id", "sha", "n_removed", "kept_sha256").dropDuplicates(["doc_id", "sha"]), ["doc_id", "sha"], "left")
    out = rows.join(state, ["doc_id", "sha"], "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= RUN_WORDS)
    return out.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
