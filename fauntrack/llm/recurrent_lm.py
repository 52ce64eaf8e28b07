"""Log-likelihood of whole documents under word counts and under a gated recurrent model.

1. Words of all documents are counted, in training documents and overall.
   Frequent ones (a HEAD_KEYS-th of all words or more, so HEAD_KEYS at most) go
   to the workers, with the WORDS most frequent as the model's own words; any
   other word is one sign of the model, times the word's share by the counts
   among such words.
2. One pass reads all texts and writes each document's signs for the model and
   its share of the base score. Words that are not frequent leave it as they
   stand, and meet the table of counts in a join.
3. The model is trained on all training documents, each of them once, in ROUNDS.
   A round takes those that a hash gives it, in tasks of about TASK_BYTES of text;
   each task runs truncated backpropagation from the round's parameters, and the
   tasks' results are averaged by Spark, weighted by tokens: a fixed number of
   parameters reaches the driver however large the input is.
4. One pass over the signs scores all documents, state carried through each.

Defined results: a null or empty text is its end token; rows are separate
documents even if their doc_id repeats; a null doc_id counts as the empty text
in the choice of held-out documents (and is held out, as crc32 of nothing is
0); an empty table gives no rows; without training documents every count is
zero; of equally frequent words those that sort first are the model's; words
over LONGEST characters are counted under their digest; one very long text is
one task's work, linear in memory; extra columns, whatever their names, are
ignored. Scores depend on how rows lie in files, as training does; base scores
do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, blocks_for, materialise, partitions, pieces, table, text_buffer, text_bytes
from .gru import Gru, Shape, Trainer, even_lanes, first_parameters, lanes

#: A word with at least one in this many of all words is known to the workers, so at most so many words are, whatever the input.
HEAD_KEYS = 1 << 19
#: Words of the model beside the end and the sign for all others.
WORDS = 1022
#: Rounds of training; together they take every training document once.
ROUNDS = 4
#: About so many bytes of text are a training task of one round; tokens that are trained on or scored together.
TASK_BYTES, SCORED = 4 << 20, 2_000_000
#: About so many bytes of text are counted at once, or read at once; a part of the join with the counts has about so many words.
COUNTED, READ, JOINED = 32 << 20, 4 << 20, 1 << 18
#: Longer words, in characters, are counted under their digest.
LONGEST = 64
#: Added to every count.
PSEUDO = 0.1

LN10 = float(np.log(10.0))


# ---------------------------------------------------------------- counts


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_key(word: str) -> str:
    """What a word is counted under: long ones under a blank, which no word holds, and their digest."""
    return " " + hashlib.sha256(word.encode()).hexdigest() if len(word) > LONGEST else word


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of the words of all texts, end to end, and how many each text has: lower-cased and split at ASCII only."""
    texts = texts.cast(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    length = pc.binary_length(words).to_numpy()
    if not length.all():  # breaks at the ends of a text leave empty ones
        real = length > 0
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words, length = words.filter(pa.array(real)), length[real]
    long = length > LONGEST
    if long.any():
        long = pa.array(long)
        words = pc.replace_with_mask(words, long, pa.array(map(word_key, words.filter(long).to_pylist()), pa.string()))
    return words, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of about COUNTED bytes of text at a time, of training documents and of all."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        words, sizes = split_words(pa.concat_arrays(table.column("text").chunks))
        words = words.dictionary_encode()
        at, trains = words.indices.to_numpy(), np.repeat(table.column("t").to_numpy(), sizes)
        n = len(words.dictionary)
        both = [pa.array(np.bincount(x, minlength=n)) for x in (at[trains], at)]
        yield from pa.table([words.dictionary, *both], ["word", "c", "n"]).to_batches(max_chunksize=BATCH_ROWS)

    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.column("text").nbytes
        if waiting > COUNTED:
            yield from counted(held)
            held, waiting = [], 0
    if held:
        yield from counted(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """A written table: word, c (in training documents), n (in all documents)."""
    each = docs.select((~is_held_out(F.col("doc_id"))).alias("t"), "text").mapInArrow(_count, "word string, c long, n long")
    return materialise(each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")


@dataclass
class Counts:
    """What tasks know of the counts: frequent words, the model's words among them, and totals."""

    tokens: int  # of training documents, ends included
    denominator: float
    end_count: int
    words: pa.Array  # frequent ones, their places those in the two arrays
    count: np.ndarray
    model_id: np.ndarray
    mass: np.ndarray  # of the model's signs, falling
    end: int
    other: int
    log_other: float  # log10 of the share, by the counts, of all words that are not the model's

    @property
    def index(self) -> dict[bytes, int]:
        return {w.encode(): k for k, w in enumerate(self.words.to_pylist())}

    def log_share(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + PSEUDO) / self.denominator)


def corpus_counts(docs: DataFrame, counts: DataFrame) -> tuple[Counts, Column]:
    """Counts for the tasks, and the condition that tells frequent words in the table of counts."""
    ends = docs.where(~is_held_out(F.col("doc_id"))).count()
    total, distinct, everything = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("n")).first()
    tokens, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)
    frequent = F.col("n") * HEAD_KEYS >= (everything or 0)
    head = sorted(((r["word"].encode(), r["c"]) for r in counts.where(frequent).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    own = [c for _, c in head[:WORDS] if c > 0]
    denominator = tokens + PSEUDO * (distinct + 1)
    rest = tokens - ends - sum(own) + PSEUDO * (distinct - (ends > 0) - len(own) + 1)  # and the words that training has not seen
    mass = np.array([*own, ends, rest]) + np.array([PSEUDO] * (len(own) + 1) + [0.0])
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), np.int64)
    place[order] = np.arange(len(mass))
    model_id = np.full(len(head), place[-1], np.int32)
    model_id[: len(own)] = place[: len(own)]
    return Counts(tokens, denominator, ends, pa.array([w.decode() for w, _ in head], pa.string()), np.array([c for _, c in head], np.int64), model_id, mass[order], int(place[-2]), int(place[-1]), float(np.log10(rest / denominator))), frequent


# ---------------------------------------------------------------- signs

_DOCUMENT_DDL = "row long, doc_id long, held_out boolean, n_known long, base_score double, beside double, signs binary, words array<string>"
#: A sign in a document's row; WORDS and two more fit.
SIGN = np.dtype("<u2")


def _read(shared):
    """Signs of every document, end included, what it has by the frequent words, and its other words; beside is what the model's score has from counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        # tables by place of a frequent word, and at the end what holds of all other words
        model_id = np.append(counts.model_id, np.int32(counts.other)).astype(SIGN)
        known = np.append(counts.count > 0, False)
        share = np.append(counts.log_share(counts.count), 0.0)
        beside = np.where(model_id == counts.other, share - counts.log_other, 0.0)
        end = counts.log_share(np.array([counts.end_count]))[0]
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for start, stop in pieces(offsets, READ):
                part = batch.slice(start, stop - start)
                words, sizes = split_words(part.column("text"))
                found = pc.index_in(words, value_set=counts.words).fill_null(-1).to_numpy()
                n = len(sizes)
                doc = np.repeat(np.arange(n), sizes)
                add = lambda x: np.bincount(doc, x[found], n)  # noqa: B023, E731
                cuts = np.append(0, np.cumsum(sizes + 1))
                signs = np.full(cuts[-1], counts.end, SIGN)
                signs[np.arange(len(found)) + doc] = model_id[found]
                rare = found < 0
                others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc[rare], minlength=n))), pa.int32()), words.filter(pa.array(rare)))
                signs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * SIGN.itemsize).astype(np.int32)), pa.py_buffer(signs)])
                columns = [pa.array(add(known).astype(np.int64) + (counts.end_count > 0)), pa.array(add(share) + end), pa.array(add(beside), pa.float64()), signs, others]
                yield pa.record_batch([*(part.column(c) for c in ("row", "doc_id", "held_out")), *columns], ["row", "doc_id", "held_out", "n_known", "base_score", "beside", "signs", "words"])

    return run


def documents(docs: DataFrame, counts: Counts) -> DataFrame:
    """A written table, a row a document; see _DOCUMENT_DDL."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return materialise(numbered.mapInArrow(_read(shared), _DOCUMENT_DDL), "lm-documents")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches of about SCORED tokens with their tokens and the sizes of their documents; a larger one stands alone."""
    held: list[pa.RecordBatch] = []
    tokens: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    waiting = 0
    for batch in batches:
        _, offsets = text_buffer(batch.column("signs"))
        for start, stop in pieces(offsets, SCORED * SIGN.itemsize):
            part = batch.slice(start, stop - start)
            data, cuts = text_buffer(part.column("signs"))
            held.append(part)
            tokens.append(np.frombuffer(data.tobytes(), SIGN).astype(np.int32))
            sizes.append(np.diff(cuts) // SIGN.itemsize)
            waiting += len(tokens[-1])
            if waiting > SCORED:
                yield held, np.concatenate(tokens), np.concatenate(sizes)
                held, tokens, sizes, waiting = [], [], [], 0
    if waiting:
        yield held, np.concatenate(tokens), np.concatenate(sizes)


# ---------------------------------------------------------------- training


def _train(shared, shape: Shape, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shape, shared.value)
        for _, tokens, sizes in _dealt(batches):
            trainer.train(even_lanes(tokens, sizes, end))
        if trainer.tokens:
            yield pa.record_batch([pa.array([trainer.tokens], pa.int64()), pa.array([trainer.model.flat], pa.list_(pa.float32()))], ["tokens", "flat"])

    return run


def train(read: DataFrame, size: int, counts: Counts, rounds: int = ROUNDS) -> tuple[Shape, np.ndarray]:
    """Parameters of the model after all rounds over documents(), whose texts have `size` bytes."""
    spark = read.sparkSession
    shape = Shape.of(counts.mass)
    flat = first_parameters(shape, counts.mass)
    tasks = blocks_for(size // rounds, TASK_BYTES)
    share = F.pmod(F.xxhash64("doc_id", "signs"), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)
        some = read.where(~F.col("held_out") & (share == k)).select("signs").coalesce(tasks)
        each = some.mapInArrow(_train(shared, shape, counts.end), "tokens long, flat array<float>")
        mean = each.select("tokens", F.posexplode("flat").alias("k", "v")).groupBy("k").agg((F.sum(F.col("v").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("v")).toArrow()
        if mean.num_rows:
            flat = np.empty(shape.size, np.float32)
            flat[mean.column("k").to_numpy()] = mean.column("v").to_numpy()
        shared.unpersist()
    return shape, flat


# ---------------------------------------------------------------- scores


def _score(shared, shape: Shape, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(shape, shared.value)
        for held, tokens, sizes in _dealt(batches):
            logs = model.scores(lanes(tokens, sizes, end), len(sizes)) / LN10
            rows = pa.Table.from_batches(held).drop_columns(["signs", "beside"]).combine_chunks()
            score = logs + np.concatenate([b.column("beside").to_numpy() for b in held])
            yield from rows.append_column("n_tokens", pa.array(sizes, pa.int64())).append_column("score", pa.array(score)).to_batches()

    return run


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts, base score and the model's score of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = word_counts(docs)
    counts, frequent = corpus_counts(docs, words)
    read = documents(docs, counts)
    shape, flat = train(read, text_bytes(docs), counts, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(flat)
    kept = read.select("row", "doc_id", "held_out", "n_known", "base_score", "beside", "signs")
    scored = materialise(kept.mapInArrow(_score(shared, shape, counts.end), "row long, doc_id long, held_out boolean, n_known long, base_score double, n_tokens long, score double"), "lm-scores")
    # both sides are dealt by word into parts whose share of the counts fits a hash table, so neither is sorted
    parts = blocks_for(words.count(), JOINED, partitions(docs.sparkSession))
    rare = read.select("row", F.explode("words").alias("word")).repartition(parts, "word")
    facts = words.where(~frequent).select("word", "c").repartition(parts, "word").hint("shuffle_hash")
    log_share = F.log10((F.col("c") + PSEUDO) / F.lit(counts.denominator))
    sums = rare.join(facts, "word").groupBy("row").agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(log_share).alias("more"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return scored.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), plus("base_score", "more"), plus("score", "more"))


def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    return score_documents(table(spark, sf_dir, "documents"))
