"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Spans: ``regexp_extract_all`` gives the matches of a pattern and ``split`` by the
same pattern gives what lies between them. Each match becomes a row with both
lengths, and a running sum over a text's rows gives the places in code points, so
the work is in proportion to the matches.

Ownership: the hashes of all candidates are counted by distinct owner and
repository over the whole corpus. A value with one owner looks live; one that
many owners carry is a copied example.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.session import cut

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short never match; a maximal run of the needed length matches as the bare pattern's run would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the method adds: long tokens that look random and that one owner alone has. Random-looking: letter and
#: digit side by side twice at least (words, dates and paths have none or one), and this many distinct characters.
OWNED = r"[A-Za-z0-9_+/-]{20,}"
SIDE_BY_SIDE, DISTINCT = r"[A-Za-z][0-9]|[0-9][A-Za-z]", 10
#: Owners from which a value counts as a copied example.
EXAMPLE_OWNERS = 3


#: Characters of the two sizes of pieces in which a text is masked.
COARSE, FINE = 1 << 20, 1 << 12


def _matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (no, seq, gap, len, hash, random) of all matches in turn; no hash where ``group`` has under ``least`` characters.

    ``gap`` is the length of what lies between a match and the one before.
    """
    p = F.lit(pattern)
    value = F.regexp_extract_all(text, p, F.lit(group))
    zipped = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("b"), value.alias("v"))
    v = lambda x: x["v"]
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("no"), i.alias("seq"), F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("len"),
            F.when(F.length(v(x)) >= least, F.sha2(v(x), 256)).alias("hash"),
            ((F.regexp_count(v(x), F.lit(SIDE_BY_SIDE)) >= 2) & (F.size(F.array_distinct(F.split(v(x), ""))) >= DISTINCT)).alias("random"),
        ),
    )
    none = F.array().cast("array<struct<no:int,seq:int,gap:int,len:int,hash:string,random:boolean>>")
    return F.when(F.regexp_like(text, p), F.filter(each, lambda x: x["len"].isNotNull())).otherwise(none)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document row: ``rid, id, spans``.

    ``spans`` is an array, by place, of (start, no, end, kind, owners, repos,
    verdict, before): code points, end exclusive; verdict ``live`` for a value with one
    owner, ``example`` from EXAMPLE_OWNERS owners, else ``shared``; before is the
    largest end of the spans before it. Base kinds are always there; an ``owned`` span
    is there only if it looks random, overlaps no base span and its value has one owner
    in the corpus. Null texts count as empty; null owners and repositories count as one
    more value. Texts of any length are whole; of spans that begin at one place the order is that of the kinds. Empty tables give empty results; repeated rows and null ids stay; other
    columns do not matter, but those named in ``carry`` come along. rid is made here and
    fits no other scan of ``docs``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    matches = F.concat(_matches(text, "assign", ASSIGN, 2, 6), _matches(text, "access", ACCESS), _matches(text, "hex", HEX), _matches(text, "owned", OWNED))
    found = cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), *carry,
            F.coalesce((F.lit("") if owner is None else owner).cast("string"), F.lit("\0")).alias("owner"),
            F.coalesce((F.lit("") if repo is None else repo).cast("string"), F.lit("\0")).alias("repo"),
            matches.alias("matches"),
        )
    )
    each = found.where(F.size("matches") > 0).select(F.col("rid"), F.col("owner"), F.col("repo"), F.explode("matches").alias("m")).select("rid", "owner", "repo", "m.*").repartition("rid")
    in_turn = Window.partitionBy("rid", "no").orderBy("seq")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_turn)).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.where("hash is not null").where((F.col("no") < KINDS.index("owned")) | F.col("random"))
    # a base span that begins at or before a place reaches past it, or the next one begins before its end
    base = F.col("no") < KINDS.index("owned")
    up_to_here = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_behind = Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    reach, following = F.max(F.when(base, F.col("end"))).over(up_to_here), F.min(F.when(base, F.col("start"))).over(from_behind)
    apart = placed.withColumn("reach", reach).withColumn("following", following)
    alone = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    spans = cut(apart.where(base | alone).select("rid", "owner", "repo", "hash", "no", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    owned = (
        spans.select("hash", "owner", "repo").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    verdict = F.when(F.col("owners") == 1, "live").when(F.col("owners") >= EXAMPLE_OWNERS, "example").otherwise("shared")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("no") + 1)
    earlier = Window.partitionBy("rid").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    judged = (
        spans.drop("repo").join(owned, "hash").where(base | (F.col("owners") == 1))
        .withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", kind.alias("kind"), "owners", "repos", verdict.alias("verdict"), "before"))).alias("spans"))
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.select("rid", "id", *carry).join(judged, "rid", "left").select("rid", "id", F.coalesce("spans", none).alias("spans"), *carry)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` (start, end and before, by start) replaced by ``mask``.

    What stays is taken from fine pieces of the text, so that no span walks the whole text.
    """
    coarse = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / COARSE).cast("int")), lambda k: F.substring(text, k * COARSE + 1, F.lit(COARSE)))
    last = lambda t: F.greatest(F.ceil(F.length(t) / FINE).cast("int") - 1, F.lit(0))
    fine = F.flatten(F.transform(coarse, lambda t: F.transform(F.sequence(F.lit(0), last(t)), lambda k: F.substring(t, k * FINE + 1, F.lit(FINE)))))

    def part(pieces: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / FINE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, F.floor(end / FINE).cast("int") - first + 1), ""), begin - first * FINE + 1, end - begin)

    def masked(pieces: Column) -> Column:
        kept = F.transform(spans, lambda x: F.when(x["start"] >= x["before"], F.concat(part(pieces, x["before"], x["start"]), F.lit(mask))).otherwise(F.lit("")))
        upto = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(kept, ""), part(pieces, upto, F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(fine), masked), 1)).otherwise(text)
