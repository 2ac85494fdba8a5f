"""Language identification of mixtures by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordhash as wh
from glyphmill.llm.common import apart

BUCKETS = 1 << 15
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram centred on each byte; space and the ends of texts count as 0."""
    pad = np.zeros(len(data) + 2, np.uint32)
    pad[1:-1] = wh.FOLD[data]
    pad[1:-1][wh.SPACE[data]] = 0
    before, after = pad[:-2].copy(), pad[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = 0, 0
    code = (before << np.uint32(16)) | (pad[1:-1] << np.uint32(8)) | after
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    """``logp[bucket, language]``: log-probabilities of byte trigrams, hashed to ``BUCKETS`` places."""

    langs: list[str]
    logp: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 2000, smooth: float = 0.5, row_id: str = "doc_id") -> Model:
    """Trigram counts of about ``sample_rows`` labelled texts per language (all if fewer).

    The bounded sample is drawn by a hash of the row's id and text, without a
    shuffle, so copies of one text are drawn one by one; the id is no input of
    the model. Null texts and labels are skipped. Counts are summed on the cluster; what
    reaches the driver is at most ``BUCKETS`` rows a language.
    """
    drawn = F.xxhash64(*[F.col(c) for c in (row_id, text) if c in docs.columns])
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(drawn, F.lit(1_000_000)).alias("drawn")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, sample_rows / v))])
    rows = rows.where(F.col("drawn") < F.element_at(share, F.col("lang")) * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(0)):
                gram = _grams(data, offsets)
                for i, name in enumerate(b.column(1).slice(lo, hi - lo).to_pylist()):
                    part = slice(offsets[i], offsets[i + 1])
                    got = np.bincount(gram[part][~wh.SPACE[data[part]]], minlength=BUCKETS)
                    total[name] = total.get(name, 0) + got
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted(n)
    table = np.full((BUCKETS, len(langs)), smooth)
    index = {x: i for i, x in enumerate(langs)}
    for r in got:
        table[r.bucket, index[r.lang]] += r.n
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32))


def _em(lik: np.ndarray, top: np.ndarray, owner: np.ndarray, at: np.ndarray, counts: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` steps and the log-likelihood of each text; zeros in ``pi`` stay."""
    for _ in range(rounds):
        r = lik * pi[owner]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, at, axis=0) / counts[:, None]
    total = (lik * pi[owner]).sum(1)
    return pi, np.add.reduceat(np.log(total) + top, at)


def mixtures(logp: np.ndarray, owner: np.ndarray, n_texts: int, rounds: int = 8, penalty: float = 2.0) -> np.ndarray:
    """Proportions [text, language] from word log-likelihoods ``logp`` [word, language], sorted by ``owner``.

    First all languages; then sets of the 1, 2, ... most frequent ones, as long
    as one more raises the log-likelihood by more than ``penalty`` times the
    logarithm of the number of words. Texts without words get zeros.
    """
    out = np.zeros((n_texts, logp.shape[1]), np.float32)
    has = np.unique(owner)
    if not len(has):
        return out
    own = np.searchsorted(has, owner)
    counts = np.bincount(own).astype(np.float32)
    at = np.concatenate(([0], np.cumsum(counts[:-1]).astype(np.int64)))
    top = logp.max(1)
    lik = np.maximum(np.exp(logp - top[:, None]), np.float32(1e-30))
    n_langs = logp.shape[1]
    full, _ = _em(lik, top, own, at, counts, np.full((len(has), n_langs), 1 / n_langs, np.float32), rounds)
    rank = np.argsort(-full, axis=1, kind="stable")
    single = np.add.reduceat(logp, at, axis=0)
    best = np.zeros_like(full)
    first = np.argmax(single, axis=1)
    best[np.arange(len(has)), first] = 1
    score = single[np.arange(len(has)), first]
    live = np.arange(len(has))
    for size in range(2, n_langs + 1):
        mask = np.zeros((len(live), n_langs), np.float32)
        np.put_along_axis(mask, rank[live, :size], 1, axis=1)
        start = (full[live] + np.float32(1e-3)) * mask
        start /= start.sum(1, keepdims=True)
        pick = np.zeros(len(has), bool)
        pick[live] = True
        rows = pick[own]
        renumber = np.cumsum(pick) - 1
        own2, counts2 = renumber[own[rows]], counts[live]
        at2 = np.concatenate(([0], np.cumsum(counts2[:-1]).astype(np.int64)))
        pi, ll = _em(lik[rows], top[rows], own2, at2, counts2, start, max(2, rounds // 2))
        better = ll - score[live] > penalty * np.log(counts2 + 1)
        win = live[better]
        best[win], score[win] = pi[better], ll[better]
        live = win
        if not len(live):
            break
    out[has] = best
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``mixture`` to the columns ``keep`` (all, if None).

    ``lang_pred`` is the language with the largest share of the text's words,
    ``score`` that share and ``mixture`` the chosen set, as ``en:0.81,de:0.19``.
    A null text, one without a letter, or a model without languages gives
    ``und``, 0 and an empty mixture. Every text is read whole; texts in one
    Arrow batch are worked on in bounded chunks. Columns that have a result's
    name are replaced; repeated rows and empty tables pass through.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "mixture")]
    fields = [docs.schema[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))  # BUCKETS rows, whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in batches:
            preds, scores, mixes = [], [], []
            texts = b.column(len(keep))
            for lo, hi, data, offsets in wh.chunks(texts) if langs else [(0, len(texts), None, None)]:
                if not langs:
                    share, lettered = np.zeros((hi, 1)), np.zeros(hi, bool)
                else:
                    starts, ends, first = wh.words(data, offsets)
                    gram = _grams(data, offsets)
                    letters = np.concatenate(([0], np.cumsum(LETTER[data])))
                    spoken = letters[ends] > letters[starts]
                    owner = np.repeat(np.arange(hi - lo), np.diff(first))
                    if len(starts):
                        per_byte = table[gram]
                        per_byte[wh.SPACE[data]] = 0
                        logp = np.add.reduceat(per_byte, starts, axis=0)[spoken]
                    else:
                        logp = np.zeros((0, len(langs)), np.float32)
                    share = mixtures(logp, owner[spoken], hi - lo)
                    plain = np.concatenate(([0], np.cumsum(LETTER[data] & (data < 128))))
                    lettered = plain[offsets[1:]] > plain[offsets[:-1]]
                    for i in np.flatnonzero(~lettered & (letters[offsets[1:]] > letters[offsets[:-1]])):
                        lettered[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode()))
                for ok, row in zip(lettered, share, strict=True):
                    if not ok or not row.any():
                        preds.append("und"), scores.append(0.0), mixes.append("")
                        continue
                    order = [k for k in np.argsort(-row, kind="stable") if row[k] >= 0.005]
                    preds.append(langs[order[0]])
                    scores.append(min(1.0, float(row[order[0]])))
                    mixes.append(",".join(f"{langs[k]}:{row[k]:.2f}" for k in order))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())], [*keep, "lang_pred", "score", "mixture"])

    schema = type(docs.schema)([*fields]).add("lang_pred", "string").add("score", "double").add("mixture", "string")
    return docs.select(*keep, F.col(text).alias(apart("own_text", keep))).mapInArrow(predict, schema)
