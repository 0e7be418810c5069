"""The thin queries over the tables that the operators are meant for."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, language, licences, minhash, pieces, secrets, sharding, tiling, token_counts, token_ids, topk, warc, whitening
from .storage import new_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # responses by their own payloads, revisits by their headers alone
    responses = warc.read_warc(spark, path).where("record_type = 'response'").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    revisits = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.select(*columns).unionByName(revisits.select(*columns))


def learnable(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs, learnable())
    found = language.identify_languages(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_items", "max_coverage", "contaminated", F.array_join(F.array_sort(F.array_distinct("items.item_id")), ",").alias("item_ids"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_ids.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_ids=(2,))
    return token_ids.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_DIGITS: list[str] = []


def piece_digests(results: pa.RecordBatch) -> pa.RecordBatch:
    """n_tokens, digests of ids and decoded text, and a checksum of the spans."""
    if not _DIGITS:
        _DIGITS.extend(map(str, range(1 << 16)))
    ids, begins, ends = (results.column(c) for c in ("ids", "begins", "ends"))
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy()
    spans = np.stack([begins.values.to_numpy(), ends.values.to_numpy()], 1).astype("<u4")
    digit = _DIGITS.__getitem__ if not len(flat) or flat.max() < len(_DIGITS) else str
    edges = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.diff(offsets)),
            pa.array([hashlib.sha256(",".join(map(digit, flat[a:b].tolist())).encode()).hexdigest() for a, b in edges]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in results.column("decoded").to_pylist()]),
            pa.array([zlib.crc32(spans[a:b].tobytes()) for a, b in edges], pa.int64()),
        ],
        ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
    )


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def piece_results(docs: DataFrame) -> DataFrame:
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"], derive=piece_digests, derived=DIGESTS)


ENCODED = "ids array<int>, begins array<int>, ends array<int>"


def encoded_with_digests(results: pa.RecordBatch) -> pa.RecordBatch:
    """Ids and spans beside the digests."""
    digests = piece_digests(results)
    lists = [results.column(c).cast(pa.list_(pa.int32())) for c in ("ids", "begins", "ends")]
    return pa.RecordBatch.from_arrays([*lists, *digests.columns], ["ids", "begins", "ends", *digests.schema.names])


def encoded_pieces(docs: DataFrame) -> DataFrame:
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"], derive=encoded_with_digests, derived=f"{ENCODED}, {DIGESTS}")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_results(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("matches")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_summaries(conversations.damage_turns(table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised("embedding").alias("x"))
    return whitening.whiten(rows, whitening.fit_whitening(rows))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_token_counts, op3_warc, op4_language_id, op5_decontamination, op6_token_files, op7_pieces, op8_shards, op9_ngram_jaccard, op10_licences, op11_conversation_repair, op12_whitening, op13_secrets)}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, w, CASE
    WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN ['short:' || array_to_string(w, ' ')] ELSE ['raw:' || text] END AS g,
    CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'raw:' || text END AS whole FROM d
), s AS (SELECT doc_id, unnest(g) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE c >= 0.8 * (len(x.g) + len(y.g) - c) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT g.doc_id, k.class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(count(*) OVER (PARTITION BY whole) AS BIGINT) AS n_copies
FROM g JOIN k ON k.node = g.doc_id LEFT JOIN n ON n.a = g.doc_id
"""


def op10_sql() -> str:
    """Base places by position, and containment of every block in every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    starts = []
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"SELECT doc_id, '{label}' AS label, i FROM d, unnest(range(0, greatest(len(w) - {len(parts) - 1}, 0))) u(i) WHERE {same}")
    words = [(label, licences.WORD_RE.findall(text)) for label, text in dict.fromkeys(licences.TEMPLATES)]
    listed = ", ".join(f"('{label}', {list(dict.fromkeys(w))}, {len(w)})" for label, w in words)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORDS}') AS w FROM documents),
b AS ({" UNION ALL ".join(starts)}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {listed}) v(label, words, half)),
likely AS (SELECT doc_id, w, label, words, half FROM d, t WHERE len(list_intersect(words, w)) >= 0.8 * len(words) - 1e-9),
blocks AS (SELECT doc_id, label, words, w[o + 1:o + 2 * half] AS block FROM likely, unnest(range(0, greatest(len(w) - half - 1, 0) + 1, half)) u(o)),
m AS (SELECT doc_id, label, max(len(list_intersect(words, block)) / CAST(len(words) AS DOUBLE)) AS c FROM blocks WHERE len(list_intersect(words, block)) >= 0.8 * len(words) - 1e-9 GROUP BY doc_id, label),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT doc_id, label, 1.0 AS c FROM b UNION ALL SELECT doc_id, label, c FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(c, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN a USING (doc_id)
"""


OP11_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), summed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(substring(key, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM src, poly
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS pair FROM seq
), costed AS (
  SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t FROM faults
), ends AS (SELECT conv_id, max(i) AS n FROM costed GROUP BY conv_id),
f AS (
  SELECT conv_id, n + 1 AS i, 0 AS f0, 4 AS f1, 2 AS f2, 0 AS f3 FROM ends
  UNION ALL
  SELECT conv_id, i, least(h0, 2 + least(h2, 2 + h3)), least(h1, 2 + least(h2, 2 + h3)), least(h2, 2 + h3), least(h3, 2 + h2) FROM (
    SELECT c.conv_id, c.i,
      least(3 + f0, CASE WHEN gone THEN 99999999 ELSE t + least(2 + f2, CASE ini WHEN 's' THEN f1 WHEN 'u' THEN f2 ELSE 99999999 END) END) AS h0,
      least(3 + f1, CASE WHEN gone THEN 99999999 ELSE t + f2 + CASE ini WHEN 'u' THEN 0 ELSE 2 END END) AS h1,
      least(3 + f2, CASE WHEN gone THEN 99999999 ELSE t + f3 + CASE ini WHEN 'a' THEN 0 ELSE 2 END END) AS h2,
      least(3 + f3, CASE WHEN gone THEN 99999999 ELSE t + f2 + CASE ini WHEN 'u' THEN 0 ELSE 2 END END) AS h3
    FROM f JOIN costed c ON c.conv_id = f.conv_id AND c.i = f.i - 1) h
), go AS (SELECT conv_id, i, [f0, f1, f2, f3] AS f FROM f),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM ends
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
    CASE WHEN edit = 'D' THEN q WHEN edit = 'K' THEN CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END WHEN q = 3 THEN 4 ELSE 3 END,
    audit || edit,
    CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text)
      ELSE list_append(turns, CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, c.ini, c.role, c.text, CASE
      WHEN c.i IS NOT NULL AND a.f[w.q] = 3 + b.f[w.q] THEN 'D'
      WHEN a.f[w.q] = 2 + a.f[CASE w.q WHEN 3 THEN 4 ELSE 3 END] THEN 'I'
      WHEN c.i IS NULL OR c.gone THEN NULL
      WHEN c.ini = 's' AND w.q = 1 AND a.f[1] = c.t + b.f[2] THEN 'K'
      WHEN c.ini = 'u' AND w.q <> 3 AND a.f[w.q] = c.t + b.f[3] THEN 'K'
      WHEN c.ini = 'a' AND w.q = 3 AND a.f[3] = c.t + b.f[4] THEN 'K'
      ELSE 'R' END AS edit
    FROM walk w JOIN go a ON a.conv_id = w.conv_id AND a.i = w.i
    LEFT JOIN go b ON b.conv_id = w.conv_id AND b.i = w.i + 1
    LEFT JOIN costed c ON c.conv_id = w.conv_id AND c.i = w.i) s
  WHERE edit IS NOT NULL
), done AS (
  SELECT w.conv_id, arg_max(audit, len(audit)) AS audit, arg_max(turns, len(audit)) AS turns FROM walk w GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM costed GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(f.f0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN f ON f.conv_id = o.conv_id AND f.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_warc": OP3_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_licences": op10_sql(), "op11_conversation_repair": OP11_SQL}
