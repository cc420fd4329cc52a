"""Document likelihood over a subword lattice: all segmentations count, weighted by unigram piece scores.

The pieces and their order come from a public vocabulary; one round of expectation over the training words turns
them into probabilities of this corpus. A forward recursion in log space sums over all segmentations of a word
(pieces are byte strings and every single byte is one, so any text has a probability), and a document's
probability is the product over its words and its end.

Distinct words are counted, learned from and scored once, spread over the cluster. Scores travel back to the
documents in two ways: the most frequent words, a table of bounded size, go to every task; all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallywatch.llm.common import ident, materialize, most_frequent, on_workers, words_of

FREQUENT_WORDS = 100_000
FREQUENT_BYTES = 64
FLUSH = 400_000
SMOOTHING = 0.1
#: Words of fewer bytes are counted in plain probabilities: 25 pieces of 1e-8 are far above the smallest number.
SHORT = 24
END = b"\0end"  # no word holds this key: it stands for the end of a document among the pieces
_DOC = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, lattice double, "
        "rare array<struct<word:binary,n:bigint>>")


def pieces_of(model_file: str) -> dict[bytes, float]:
    """Natural-log weights of a public vocabulary's pieces, as byte strings with a space for the word mark.

    Merge vocabularies score a piece by its rank; ranks become weights by Zipf's law. The 256 single bytes are
    always included.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    weights = {bytes([b]): 0.0 for b in range(256)}
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    for i in plain:
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        weights[piece] = weights.get(piece, 0.0) + 1 / (1.0 - model.get_score(i))
    least = 1 / (1.0 + len(plain))
    total = math.fsum(max(w, least) for w in weights.values()) + least
    return {piece: math.log(max(w, least) / total) for piece, w in weights.items()} | {END: math.log(least / total)}


def _log_sum(terms: list[float]) -> float:
    most = max(terms)
    return most if len(terms) == 1 else most + math.log(math.fsum(math.exp(t - most) for t in terms))


class Lattice:
    """All segmentations of a word into pieces with natural-log weights."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        self._weights = weights
        self._plain = {piece: math.exp(w) for piece, w in weights.items() if piece != END}
        self._longest = max((len(p) for p in weights if p != END), default=1)

    def _arcs(self, text: bytes, end: int) -> list[tuple[int, float]]:
        get = self._weights.get
        arcs = []
        for start in range(max(0, end - self._longest), end):
            weight = get(text[start:end])
            if weight is not None:
                arcs.append((start, weight))
        return arcs

    def log_prob(self, word: bytes) -> float:
        """Natural log of the word's marginal probability."""
        text, get, longest = b" " + word, self._weights.get, self._longest
        exp, log = math.exp, math.log
        ahead = [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for start in range(end - longest if end > longest else 0, end):
                weight = get(text[start:end])
                if weight is not None:
                    terms.append(ahead[start] + weight)
            most, total = max(terms), 0.0
            for term in terms:
                total += exp(term - most)
            ahead.append(most + log(total))
        return ahead[-1]

    def add_expected(self, word: bytes, times: float, into: dict[bytes, float]) -> None:
        """Add how often each piece is expected in ``times`` occurrences of the word."""
        if len(word) < SHORT:
            self._add_short(b" " + word, times, into)
        else:
            self._add_long(b" " + word, times, into)

    def _add_short(self, text: bytes, times: float, into: dict[bytes, float]) -> None:
        """In plain probabilities, which a short word cannot bring below the smallest number."""
        get, longest, size = self._plain.get, self._longest, len(text)
        ahead, arcs = [1.0], []
        for end in range(1, size + 1):
            total = 0.0
            for start in range(max(0, end - longest), end):
                weight = get(text[start:end])
                if weight is not None:
                    total += ahead[start] * weight
                    arcs.append((start, end, weight))
            ahead.append(total)
        behind = [0.0] * size + [times / ahead[-1]]
        for start, end, weight in reversed(arcs):
            flow = behind[end] * weight
            behind[start] += flow
            piece = text[start:end]
            into[piece] = into.get(piece, 0.0) + ahead[start] * flow

    def _add_long(self, text: bytes, times: float, into: dict[bytes, float]) -> None:
        arcs = [self._arcs(text, end) for end in range(len(text) + 1)]
        ahead = [0.0]
        for end in range(1, len(text) + 1):
            ahead.append(_log_sum([ahead[start] + w for start, w in arcs[end]]))
        behind: list[list[float]] = [[] for _ in text] + [[0.0]]
        whole = ahead[-1]
        for end in range(len(text), 0, -1):
            if not behind[end]:
                continue
            rest = _log_sum(behind[end])
            for start, w in arcs[end]:
                behind[start].append(rest + w)
                piece = text[start:end]
                into[piece] = into.get(piece, 0.0) + times * math.exp(ahead[start] + w + rest - whole)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their number in training texts; zero for words of held-out texts alone."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for text, held_out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py())
            if held_out:
                for word in words:
                    seen.setdefault(word, 0)
            else:
                seen.update(words)
            if len(seen) > FLUSH:
                yield out()
    if seen:
        yield out()


def _expected(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(weights.value), {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.add_expected(word, n, total)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.float64())], ["piece", "n"])
    return run


def _score_words(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights.value)
        for batch in batches:
            scores = [lattice.log_prob(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["word", "n", "lattice"])
    return run


def _score_documents(frequent, ends: int, end_weight: float):
    schema = to_arrow_schema(StructType.fromDDL(_DOC))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text, held_out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                n_known, logs, lattice, rare = int(ends > 0), [math.log10(ends + 1)], [end_weight], []
                for word, times in Counter(words).items():
                    found = known.get(word)
                    if found is None:
                        rare.append({"word": word, "n": times})
                    else:
                        n, weight = found
                        n_known += times if n else 0
                        logs.append(times * math.log10(n + 1))
                        lattice.append(times * weight)
                rows.append((row, doc_id, held_out, len(words) + 1, n_known, math.fsum(logs), math.fsum(lattice), rare))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def score_documents(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 7, held_fold: int = 2, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """All rows: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words have A-Z lower-cased; a document's end is a token. Texts whose crc32 of the id as text falls in
    ``held_fold`` are held out; the others teach both models. ``base_score`` adds one to every count; ``score`` is the
    log10 probability by the lattice. Null texts are empty documents, a null id counts as an empty string, repeated
    rows are scored (and learned from) each, no rows give no rows; other columns are ignored. Without training texts
    the lattice keeps the vocabulary's own weights. The driver reads one number per piece and the ``frequent_words``
    most frequent words of at most 64 bytes, which bound both broadcasts.
    """
    spark = docs.sparkSession
    on_workers(spark)
    fold = F.pmod(F.crc32(F.coalesce(ident(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(ident(id_col).cast("long").alias("doc_id"), F.coalesce(ident(text_col), F.lit("")).alias("text"), (fold == held_fold).alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(_count_words, "word binary, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct")).first()
    ends = rows.filter(~F.col("held_out")).count()
    train_tokens, distinct = totals["n"] + ends, totals["distinct"] + (ends > 0)

    share = spark.sparkContext.broadcast
    weights = pieces_of(model_file)
    if ends:
        expected = words.filter("n > 0").mapInArrow(_expected(share(weights)), "piece binary, n double")
        found = {bytes(r["piece"]): r["n"] for r in expected.groupBy("piece").agg(F.sum("n").alias("n")).collect()} | {END: float(ends)}
        total = math.log(math.fsum(found.values()) + SMOOTHING * len(weights))
        weights = {piece: math.log(found.get(piece, 0.0) + SMOOTHING) - total for piece in weights}
    scored = materialize(words.mapInArrow(_score_words(share(weights)), "word binary, n long, lattice double"), "lm-scored")
    top = most_frequent(scored.filter(F.length("word") <= FREQUENT_BYTES), frequent_words)
    frequent = share({bytes(r["word"]): (r["n"], r["lattice"]) for r in top})

    judged = materialize(rows.mapInArrow(_score_documents(frequent, ends, weights[END]), _DOC), "lm-documents")
    rare = judged.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rest = rare.join(scored, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(F.col("times") * F.col("lattice")).alias("more_lattice"))
    plus = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("more_known", "more_logs", "more_lattice")}
    base = F.col("logs") + plus["more_logs"] - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)
    return judged.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + plus["more_known"]).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        ((F.col("lattice") + plus["more_lattice"]) / math.log(10)).alias("score"))
