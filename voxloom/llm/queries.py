"""The numbered queries ``opN_<name>`` over the whole input tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, chat, html_text, langid, merkle, packing, prefix_trie, quality, secrets, simhash, topk, toxicity, winnow
from voxloom.llm.labelled import fold
from voxloom.session import read_table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed tokenizer files are; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 3-word-shingle fingerprints at 3 or fewer differing bits."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; labels of fold 0 of 5 are never read."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, folds=5, held_out=0)
    score = F.col("quality_score")
    return quality.score_texts(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word benchmark windows in every document."""
    found = winnow.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    found = topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; sources are owners, source and language name a repository."""
    docs = read_table(spark, sf_dir, "documents")
    spans = secrets.secret_spans(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return spans.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"), verdict("example").alias("n_example"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores; labels of fold 1 of 3 are never read."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, folds=3, held_out=1)
    score = F.col("toxicity")
    return toxicity.score_texts(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"), "flagged"
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model is counted over all documents."""
    model = langid.fit_text_model(read_table(spark, sf_dir, "documents"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return langid.identify(pages, model)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the texts that they stand for."""
    path = vocabulary_path("byte_bpe_50k.json")
    texts = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return texts.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle tree by language over all documents; where 7 divides crc32(doc_id), the proof is tried on a row with one more in n_chars."""
    fields = lambda n: merkle.digest(*[merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    n_chars = F.col("n_chars")
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull(), fields(n_chars + 1))
    rows = merkle.manifest(read_table(spark, sf_dir, "documents"), fields(n_chars), carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(merkle.siblings(F.col("path")), "").cast("binary"), 256)
    found = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the conversations, each of which begins with turns of the first one of its five."""
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    nodes = prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), base=conv - conv % 5, heads=heads, most=8)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends_digest").alias("ends_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_quality, op3_html, op4_decontamination, op5_packing, op6_topk, op7_chat, op8_secrets, op9_toxicity, op10_langid, op11_bpe, op12_merkle, op13_prefix_trie)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of a text's bytes (ASCII alone), unsigned.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::UBIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

ORACLES = {
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        cand AS (
            SELECT rid, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram
            FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
        hit AS (SELECT rid, k, cand.size, item_id FROM cand JOIN win ON cand.gram = win.gram AND cand.size = win.size),
        pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM hit) GROUP BY rid),
        named AS (
            SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
            FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (rid) LEFT JOIN named USING (rid)""",
    "op12_merkle": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format("n_chars")} AS leaf,
                   CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format("(n_chars + 1)")} END AS tampered
            FROM documents),
        ranked AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nr, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
        tree AS (
            SELECT grp, 0 AS k, nr, leaf AS h, n FROM ranked
            UNION ALL SELECT grp, k + 1, nr // 2, sha256(string_agg(h, '' ORDER BY nr)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY grp, k, nr // 2),
        subroots AS MATERIALIZED (
            SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS nr, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
            SELECT 0 AS k, nr, subroot AS h, n FROM subroots
            UNION ALL SELECT k + 1, nr // 2, sha256(string_agg(h, '' ORDER BY nr)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY k, nr // 2),
        steps AS (
            SELECT r.rid, t.k, (r.nr >> t.k) % 2 AS bit, s.h
            FROM ranked r JOIN tree t ON t.grp = r.grp AND t.nr = r.nr >> t.k AND t.n > 1
            LEFT JOIN tree s ON s.grp = t.grp AND s.k = t.k AND s.nr = xor(t.nr, 1)
            UNION ALL
            SELECT r.rid, 100 + t.k, (g.nr >> t.k) % 2, s.h
            FROM ranked r JOIN subroots g USING (grp) JOIN top t ON t.nr = g.nr >> t.k AND t.n > 1 LEFT JOIN top s ON s.k = t.k AND s.nr = xor(t.nr, 1)),
        paths AS (SELECT rid, list(struct_pack(bit := bit, h := h) ORDER BY k) AS path, coalesce(string_agg(h, '' ORDER BY k), '') AS hashes FROM steps GROUP BY rid),
        folded AS (
            SELECT rid, list_reduce(list_prepend(struct_pack(bit := 0::BIGINT, h := coalesce(tampered, leaf)), coalesce(path, [])),
                                    lambda x, s: struct_pack(bit := 0::BIGINT, h := sha256(CASE WHEN s.bit = 1 THEN coalesce(s.h, '') || x.h ELSE x.h || coalesce(s.h, '') END))).h AS folded_root
            FROM ranked LEFT JOIN paths USING (rid))
        SELECT doc_id, leaf, subroot, top.h AS root, sha256(coalesce(hashes, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
        FROM ranked JOIN subroots USING (grp) JOIN top ON top.n = 1 JOIN folded USING (rid) LEFT JOIN paths USING (rid)""",
    "op13_prefix_trie": f"""
        WITH t AS MATERIALIZED (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        parts AS (
            SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
            UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
        r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts),
        p AS MATERIALIZED (
            SELECT conv_id, depth, strlen(text) AS bytes,
                   string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS pre
            FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        e AS (SELECT depth, pre, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth, max_by(pre, depth) AS pre FROM p GROUP BY conv_id) GROUP BY depth, pre),
        n AS MATERIALIZED (SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, pre),
        up AS MATERIALIZED (
            SELECT n.depth, n.pre, n.n_convs, n.bytes, a.depth AS a_depth, a.pre AS a_pre
            FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
        kids AS (SELECT a_depth AS depth, a_pre AS pre, count(*) AS n_children FROM up WHERE depth = a_depth + 1 GROUP BY 1, 2),
        sub AS (
            SELECT a_depth AS depth, a_pre AS pre, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM kids k WHERE k.depth = up.depth AND k.pre = up.pre)) AS n_leaves
            FROM up GROUP BY 1, 2)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN sub USING (depth, pre) LEFT JOIN kids USING (depth, pre) LEFT JOIN e USING (depth, pre)
        LEFT JOIN up ON up.depth = n.depth AND up.pre = n.pre AND up.a_depth = n.depth - 1 LEFT JOIN n q ON q.depth = up.a_depth AND q.pre = up.a_pre""",
    "op6_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op7_chat": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        p AS (
            SELECT conv_id, role, text, turn,
                   row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                   string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS pre
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        ends AS (SELECT pre, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY pre),
        kept AS (SELECT conv_id FROM ends WHERE pre NOT IN (SELECT pre FROM p WHERE pos < n))
        SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_assistant,
               string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
        FROM t JOIN kept USING (conv_id) GROUP BY conv_id""",
    "op8_secrets": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
        m AS (
            SELECT rid, owner, repo, 0 AS no, regexp_extract_all(t, '{secrets.ASSIGN.replace("'", "''")}', 0) AS w, regexp_extract_all(t, '{secrets.ASSIGN.replace("'", "''")}', 2) AS v, regexp_split_to_array(t, '{secrets.ASSIGN.replace("'", "''")}') AS b FROM d
            UNION ALL SELECT rid, owner, repo, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
            UNION ALL SELECT rid, owner, repo, 2, regexp_extract_all(t, '[0-9a-f]{{24,}}', 0), regexp_extract_all(t, '[0-9a-f]{{24,}}', 0), regexp_split_to_array(t, '[0-9a-f]{{24,}}') FROM d
            UNION ALL SELECT rid, owner, repo, 3, regexp_extract_all(t, '{secrets.OWNED}', 0), regexp_extract_all(t, '{secrets.OWNED}', 0), regexp_split_to_array(t, '{secrets.OWNED}') FROM d),
        e AS (SELECT rid, owner, repo, no, w, v, b, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
        s AS (
            SELECT rid, owner, repo, no, v[i] AS value,
                   CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(w[i]) AS n
            FROM e WHERE length(v[i]) >= CASE no WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END),
        apart AS (
            SELECT * FROM s WHERE no < 3 OR (len(regexp_extract_all(value, '{secrets.SIDE_BY_SIDE}')) >= 2 AND len(list_distinct(string_split(value, ''))) >= {secrets.DISTINCT}
                AND NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.no < 3 AND b.a < s.a + s.n AND s.a < b.a + b.n))),
        own AS (SELECT value, count(DISTINCT owner) AS owners FROM apart GROUP BY value),
        j AS (
            SELECT rid, no, a, a + n AS z, owners, CASE no WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END AS kind
            FROM apart JOIN own USING (value) WHERE no < 3 OR owners = 1),
        g AS (
            SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
                   string_agg(concat_ws(':', kind, a, z), ',' ORDER BY a, no) FILTER (no < 3) AS base, string_agg(concat_ws(':', kind, a, z), ',' ORDER BY a, no) AS spans,
                   count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= 3) AS n_example
            FROM j GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
        FROM d LEFT JOIN g USING (rid)""",
}
