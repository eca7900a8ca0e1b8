"""Language identification by Bayesian evidence fusion.

log P(lang | page) = text likelihood + declared markup language + address suffix
+ host prior. The text model is naive Bayes over hashed byte trigrams, counted
over every training document. How far the declared language and the suffix are
to be believed is counted from the pages themselves (soft counts of the text's
verdict), and so are the host priors, which are smoothed level by level: host,
its parent domain, its top domain, all pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.llm.html_text import main_text
from voxloom.session import cut

BITS = 14
#: Trigrams that the text counts for at most, as if independent.
EFFECTIVE = 60
#: Pages' worth of belief in the level above.
PRIOR_WEIGHT, EVIDENCE_WEIGHT = 4.0, 2.0
#: Bytes of a text worked on at a time.
PIECE = 1 << 18
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH_LANG = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#-]|$)"


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of the letters of a whole text, runs of other characters as one space."""
    out = np.zeros(1 << BITS, np.int64)
    if not text:
        return out
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    for a in range(0, max(1, len(raw) - 2), PIECE):
        b = np.frombuffer(raw[a : a + PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]
            out += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class TextModel:
    """Log-likelihoods of trigram buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.loglik = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else np.zeros((0, 1 << BITS))

    def logs(self, text: str | None) -> np.ndarray:
        """Tempered log-likelihood of each language; zeros for a text without letters."""
        c = trigram_counts(text)
        n = c.sum()
        at = np.nonzero(c)[0]
        return self.loglik[:, at] @ c[at] * (min(1.0, EFFECTIVE / n) if n else 0.0)


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Counts over all documents with a language: each task adds up its own, a grouped sum merges them.

    What reaches the driver is one row per language and bucket.
    """

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in few_rows(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in held:
                    held[lang] += trigram_counts(text)
                else:
                    held[lang] = trigram_counts(text)
        for lang, c in held.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    table = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), 1 << BITS))
    place = {v: i for i, v in enumerate(langs)}
    counts[[place[v] for v in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return TextModel(langs, counts)


def _posterior(logs: Column) -> Column:
    """Normalised exponentials of an array of logs."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with host, declared, suffix_lang, text_lang, lang and score.

    ``score`` is the posterior of ``lang``. Pages without text, address or
    declaration are judged by the evidence that is there; with none at all they
    get the most common language. Ties go to the first language by name. Without
    any training document lang is null and the score 0. Hosts that hold a large
    share of the pages cost one row per task in the grouped sums. Pages of any length are read whole; a
    repeated row is one more page, also in the sums. Columns of the
    names above are replaced.
    """
    langs, k = model.langs, len(model.langs)
    made = ("host", "declared", "suffix_lang", "text_lang", "lang", "score")
    rest = [c for c in pages.columns if c not in (html_col, *made)]
    if not k:
        blank = pages.select(*rest)
        for c in made[:-1]:
            blank = blank.withColumn(c, F.lit(None).cast("string"))
        return blank.withColumn("score", F.lit(0.0))

    def run(batches):
        for b in few_rows(batches):
            logs = [model.logs(main_text(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(logs, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "logs"])

    url, page = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, HOST, 1))
    declared = F.lower(F.regexp_extract(page, DECLARED, 1))
    top = F.substring_index(host, ".", -1)
    suffix = F.when(F.length(F.regexp_extract(url, PATH_LANG, 1)) > 0, F.lower(F.regexp_extract(url, PATH_LANG, 1))).otherwise(top)
    held = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], host.alias("host"), declared.alias("declared"), suffix.alias("suffix"), F.col(html_col).cast("string").alias("html"))
    fields = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    seen = cut(held.mapInArrow(run, f"{fields}host string, declared string, suffix string, logs array<double>"))
    seen = seen.withColumn("p", _posterior(F.col("logs"))).withColumn("parent", F.substring_index("host", ".", -2)).withColumn("top", F.substring_index("host", ".", -1))

    total = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    sums = F.array(*[f"s{i}" for i in range(k)])
    everything = seen.agg(*total).first()
    flat = np.array([x or 0.0 for x in everything]) + 1.0
    overall = F.array(*[F.lit(float(x)) for x in flat / flat.sum()])

    def smoothed(above: Column) -> Column:
        n = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(sums, above, lambda s, q: (s + PRIOR_WEIGHT * q) / (n + PRIOR_WEIGHT))

    tops = seen.groupBy("top").agg(*total).select("top", smoothed(overall).alias("q_top"))
    parents = seen.groupBy("parent", "top").agg(*total).join(tops, "top").select("parent", smoothed(F.col("q_top")).alias("q_parent"))
    hosts = seen.groupBy("host", "parent").agg(*total).join(parents, "parent").select("host", smoothed(F.col("q_parent")).alias("prior"))

    def believed(name: str) -> DataFrame:
        """log P(value | language), up to a factor that all languages share."""
        share = F.zip_with(sums, overall, lambda s, q: (s + EVIDENCE_WEIGHT * q) / q)
        return seen.groupBy(name).agg(*total).select(name, F.transform(share, lambda x: F.log(x)).alias(f"log_{name}"))

    joined = seen.join(hosts, "host").join(believed("declared"), "declared").join(believed("suffix"), "suffix")
    fused = F.transform(
        F.arrays_zip("logs", F.transform("prior", lambda x: F.log(x)).alias("h"), "log_declared", "log_suffix"),
        lambda e: e["logs"] + e["h"] + F.when(F.col("declared") == "", 0.0).otherwise(e["log_declared"]) + F.when(F.col("suffix") == "", 0.0).otherwise(e["log_suffix"]),
    )
    names = F.array(*map(F.lit, langs))
    pick = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    known = lambda c: F.when(F.col(c).isin(langs), F.col(c))
    return (
        joined.withColumn("post", _posterior(fused))
        .select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
            "host", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), known("suffix").alias("suffix_lang"),
            pick(F.col("logs")).alias("text_lang"), pick(F.col("post")).alias("lang"), F.array_max("post").alias("score"),
        )
    )
