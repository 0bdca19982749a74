"""Language identification by Bayesian fusion of four kinds of evidence.

* text: character trigrams under one smoothed model a language, learnt from labelled rows. Trigrams overlap and repeat, so a text counts
  for at most ``certainty`` of them; the result is a likelihood, not yet a verdict;
* the language that the markup declares, and the language of the address's country suffix: both are believed as far as they agree
  with the texts, by a confusion table counted over the corpus;
* the host: its own language shares, smoothed towards its domain's, these towards the corpus's, by grouped sums of
  the text posteriors. A document's own share is taken out before it is judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import durable

_CELLS = 1 << 16
_SLICE = 1 << 18
#: Country suffixes and the language that most of their pages have.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en",
            "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko"}


@dataclass(frozen=True)
class Model:
    """Languages and log probabilities of trigram cells, ``weights[cell, language]``; its size does not depend on the corpus."""

    languages: tuple[str, ...]
    weights: np.ndarray


def _slices(text: str | None) -> Iterator[np.ndarray]:
    """Trigram cells of a text, over the bytes of its lower-cased letters with one blank for everything else; none without letters.

    The text is read ``_SLICE`` characters at a time, and each slice carries on where the last one ended.
    """
    line, inside, found = np.array([32], np.uint32), True, False
    for start in range(0, len(text or ""), _SLICE):
        raw = np.frombuffer(text[start:start + _SLICE].lower().encode("utf-8", "surrogatepass"), np.uint8)
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        kept = letter | np.concatenate(([inside], letter[:-1]))  # of several other signs the first stays
        line = np.concatenate((line[-2:], np.where(letter, raw, 32)[kept].astype(np.uint32)))
        inside, found = letter[-1], found or bool(letter.any())
        if found:
            yield _hashed(line)
    if found:
        yield _hashed(np.concatenate((line[-2:], np.array([32], np.uint32))))


def _hashed(line: np.ndarray) -> np.ndarray:
    code = (line[:-2] << 16) | (line[1:-1] << 8) | line[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(labelled: DataFrame, train_rows: int = 20_000, smoothing: float = 0.5) -> Model:
    """A model from a bounded sample of ``labelled(text, lang)``: about ``train_rows`` rows, chosen by a hash of their text.

    Rows without text or label are left out. The counts are a grouped sum; the driver gets languages * 65,536 numbers at most.
    """
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.lower("lang").alias("lang")).filter("text is not null and lang is not null")
    n = usable.count()
    cut = int(min(1.0, train_rows / max(n, 1)) * (1 << 20))
    sample = usable.filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 20)) < cut)

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                n = np.zeros(_CELLS, np.int64)
                for text in (t for t, x in zip(batch.column(0).to_pylist(), langs) if x == lang):
                    for cells in _slices(text):
                        n += np.bincount(cells, minlength=_CELLS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "cell", "n"])

    rows = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    weights = np.full((_CELLS, max(1, len(languages))), smoothing)
    for r in rows:
        weights[r["cell"], languages.index(r["lang"])] += r["n"]
    return Model(languages or ("und",), np.log(weights / weights.sum(0)))


def text_evidence(rows: DataFrame, model: Model, certainty: float) -> DataFrame:
    """``rows`` (with ``text``) as all other columns and ``grams long, evidence array<double>``: log likelihoods, the best one 0."""
    languages = len(model.languages)
    weights = rows.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))  # languages * 65,536 numbers
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        table = weights.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            evidence, grams = np.zeros((len(texts), languages)), np.zeros(len(texts), np.int64)
            held, owners, size = [], [], 0

            def add_up() -> None:
                starts = np.cumsum([0, *(len(h) for h in held[:-1])])
                np.add.at(evidence, owners, np.add.reduceat(table[np.concatenate(held)].astype(np.float64), starts))

            for i, text in enumerate(texts):
                for cells in _slices(text):
                    if len(cells):
                        held.append(cells)
                        owners.append(i)
                        grams[i] += len(cells)
                        size += len(cells)
                    if size >= _SLICE:  # memory follows a slice, not a text
                        add_up()
                        held, owners, size = [], [], 0
            if held:
                add_up()
            n = np.maximum(grams, 1)[:, None]
            evidence = evidence / n * np.minimum(n, certainty)
            evidence -= evidence.max(1, keepdims=True) if len(texts) else 0
            lists = pa.ListArray.from_arrays(np.arange(0, evidence.size + 1, languages, dtype=np.int32), pa.array(evidence.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(grams), lists],
                                             [*(f.name for f in kept), "grams", "evidence"])
    schema = T.StructType([*kept, T.StructField("grams", T.LongType()), T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    return rows.select(*(f"`{f.name}`" for f in kept), "text").mapInArrow(run, schema)


def _share(log: Column) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(log)
    weights = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def _sums(column: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def _believed(rows: DataFrame, column: str, languages: Sequence[str]) -> Column:
    """log P(declared value | language) for each row, from the text posteriors of the rows that declare it, with one added to each count."""
    n = len(languages)
    counted = {r[0]: r[1] for r in rows.groupBy(column).agg(_sums("share", n)).collect()}  # a row for each language, 'other' and 'none'
    values = [*languages, "other", "none"]
    total = [sum(c[i] for c in counted.values()) + len(values) for i in range(n)]
    out = F.array(*(F.lit(math.log(1 / t)) for t in total))
    for value, sums in counted.items():
        out = F.when(F.col(column) == value, F.array(*(F.lit(math.log((s + 1) / t)) for s, t in zip(sums, total)))).otherwise(out)
    return out


def identify(rows: DataFrame, model: Model, certainty: float = 30.0, inertia: float = 5.0, least: float = 0.5, wanted: Sequence[str] | None = None) -> DataFrame:
    """``rows`` without ``text``, ``declared`` and ``host``, and with ``lang, confidence, text_lang, accepted``.

    ``rows`` holds ``text``, ``declared`` (a language code, with or without region), ``host`` (a name with dots, or any source name), all of which
    may be null, and any other columns. ``lang`` is the language with the highest posterior, the first of equals, and
    ``confidence`` that posterior; ``text_lang`` goes by the text alone. A row is accepted if its text has a letter, the confidence is
    ``least`` or more and ``wanted``, if given, has the language. Texts without letters are ``und``, with the posterior of
    the other evidence as confidence, and not accepted. A null or empty host has the corpus's prior. Equal rows are judged alike.
    Texts of any length are read whole, a slice at a time.
    """
    languages, n = model.languages, len(model.languages)
    known = F.lower(F.regexp_extract(F.trim(F.col("declared")), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    suffix = F.lower(F.regexp_extract("host", r"\.([A-Za-z]{2})$", 1))
    spoken = F.lit("none")
    for code, lang in SUFFIXES.items():
        spoken = F.when(suffix == code, F.lit(lang if lang in languages else "other")).otherwise(spoken)
    host = F.lower(F.coalesce(F.col("host"), F.lit("")))
    kept = [c for c in rows.columns if c not in ("text", "declared", "host")]
    packed = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept))  # out of the way of the columns made here
    named = rows.withColumns({"_declared": F.when(F.coalesce(F.trim(F.col("declared")), F.lit("")) == "", "none").when(known.isin(*languages), known).otherwise("other"),
                              "_suffix": F.when(F.col("host").isNull(), "none").otherwise(spoken), "_host": host,
                              "_domain": F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(host)})
    named = named.select(packed.alias("_kept"), "_declared", "_suffix", "_host", "_domain", F.col("text").cast("string").alias("text"))
    scored = durable(text_evidence(named, model, certainty).withColumn("share", _share(F.col("evidence"))))

    hosts = scored.filter("_host <> ''").groupBy("_domain", "_host").agg(F.count(F.lit(1)).alias("n"), _sums("share", n).alias("own"))
    hosts = durable(hosts)
    domains = hosts.groupBy("_domain").agg(F.sum("n").alias("domain_n"), _sums("own", n).alias("domain"))
    corpus = scored.agg(F.count(F.lit(1)), _sums("share", n)).first()
    overall = [((x or 0.0) + 1) / ((corpus[0] or 0) + n) for x in (corpus[1] or [0.0] * n)]
    base = F.array(*(F.lit(x) for x in overall))

    def smoothed(sums: str, size: str, above: Column) -> Column:
        """Shares of a group without the row itself, with ``inertia`` pseudo-rows of the group above."""
        less = F.zip_with(F.coalesce(F.col(sums), F.col("share")), F.col("share"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.greatest(F.coalesce(F.col(size), F.lit(1)) - 1, F.lit(0)) + inertia
        return F.zip_with(less, above, lambda a, b: (a + inertia * b) / total)

    placed = scored.join(hosts.join(domains, "_domain").drop("_domain"), "_host", "left")
    prior = smoothed("own", "n", smoothed("domain", "domain_n", base))
    log = F.transform(prior, lambda x: F.log(F.greatest(x, F.lit(1e-9))))
    for more in (F.col("evidence"), _believed(scored, "_declared", languages), _believed(scored, "_suffix", languages)):
        log = F.zip_with(log, more, lambda a, b: a + b)
    names = F.array(*(F.lit(x) for x in languages))
    best = lambda p: names[F.array_position(p, F.array_max(p)).cast("int") - 1]
    judged = placed.withColumn("_posterior", _share(log))
    judged = judged.withColumns({"lang": F.when(F.col("grams") > 0, best(F.col("_posterior"))).otherwise("und"), "confidence": F.array_max("_posterior"),
                                 "text_lang": F.when(F.col("grams") > 0, best(F.col("share"))).otherwise("und")})
    accepted = (F.col("grams") > 0) & (F.col("confidence") >= least)
    if wanted is not None:
        accepted = accepted & F.col("lang").isin(*wanted)
    return judged.select(*(F.col("_kept").getField(c).alias(c) for c in kept), "lang", "confidence", "text_lang", accepted.alias("accepted"))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, the commonest character references resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(code), F.lit(sign))
    return bare


def page_language(html: Column) -> Column:
    """The language that a page's markup declares; empty if none."""
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z\-_]+)""", 1)
