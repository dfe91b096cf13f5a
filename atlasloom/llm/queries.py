"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ORACLES, QUERIES, query, table  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query()
def op1_two_pass_shuffle(spark, sf) -> DataFrame:
    """Operator 1: shard and slot of every document under the `key` law."""
    from .sharding import shuffle_shards

    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shuffle_shards(table(spark, sf, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


@query()
def op2_bfd_windows(spark, sf) -> DataFrame:
    """Operator 2: one row per segment of the packed windows."""
    from .bfd import pack_best_fit, window_pieces

    pieces = window_pieces(pack_best_fit(table(spark, sf, "documents"), tokenizer_path()))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op3_bootstrapped(spark, sf) -> DataFrame:
    """Operator 3: personal data in every document."""
    from .pii import digest, found_spans

    return digest(found_spans(table(spark, sf, "documents")))


@query()
def op4_noisy_channel(spark, sf) -> DataFrame:
    """Operator 4: toxicity of every document."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP5_SQL = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, upper_lower),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, upper_lower),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, CAST(len(w) AS BIGINT) - 9))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(OP5_SQL)
def op5_aho_corasick(spark, sf) -> DataFrame:
    """Operator 5: benchmark windows in every document."""
    from .decontaminate import benchmark_hits, digest

    return digest(benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query()
def op6_previous_factors(spark, sf) -> DataFrame:
    """Operator 6: repeated byte strings removed from every document."""
    from .lpf import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf, "documents")))


@query()
def op7_hyperdimensional(spark, sf) -> DataFrame:
    """Operator 7: predicted language of every document."""
    from .hdlang import identify

    return identify(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op8_simhash_trie(spark, sf) -> DataFrame:
    """Operator 8: fingerprint and component of every document."""
    from .simhash import duplicate_groups, fingerprint_hex

    groups = duplicate_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def packed_digest(docs: DataFrame) -> DataFrame:
    from .packing import pack_online

    return pack_online(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op9_merkle(spark, sf) -> DataFrame:
    """Operator 9: fingerprints of every text and of its edited text."""
    from .merkle import edited_fingerprints

    return edited_fingerprints(table(spark, sf, "documents"))


@query()
def op10_sum_of_squares(spark, sf) -> DataFrame:
    """Operator 10: one row per packed piece."""
    return packed_digest(table(spark, sf, "documents"))


@query()
def op11_multiprobe(spark, sf) -> DataFrame:
    """Operator 11: the 20 nearest rows of every twentieth vector."""
    from .multiprobe import search

    rows = table(spark, sf, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0"))


def _bytes(text: str) -> str:
    code = lambda k: f"strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + {k}, 1)) - 1"
    return f"list_transform(range(octet_length(encode({text}))), lambda i: ({code(1)}) * 16 + {code(2)})"


def _crc32(text: str) -> str:
    """CRC-32 of a text in SQL; `tbl` comes from `CRC_TABLE`."""
    return f"xor(list_reduce(list_prepend(4294967295, {_bytes(text)}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"""


def _leaf(**changed: str) -> str:
    """The hash of a row in SQL, each field with its length in bytes in front."""
    texts = [f"CAST({changed.get(c, c)} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per_doc AS (SELECT doc, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY doc, run),
keyed AS (SELECT doc, run, c, {_crc32("(doc || ':' || run)")} AS h FROM per_doc, crc_table),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM keyed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gaps AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN forms f ON way.here = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(here, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
"""


@query(OP12_SQL)
def op12_bloom_neighbours(spark, sf) -> DataFrame:
    """Operator 12: spelling variants of the words of all documents."""
    from .spelling import counted_words, variants

    return variants(counted_words(table(spark, sf, "documents"), drop_every=97)).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf(n_chars='(n_chars + 1)')} END AS tampered FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
inner_tree AS (SELECT lang, 0 AS h, pos, n, leaf AS d FROM placed
  UNION ALL SELECT lang, h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM inner_tree WHERE n > 1 GROUP BY lang, h, pos // 2, n),
subroots AS (SELECT lang, d AS subroot, h AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
outer_tree AS (SELECT 0 AS h, place AS pos, n, subroot AS d FROM subroots
  UNION ALL SELECT h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM outer_tree WHERE n > 1 GROUP BY h, pos // 2, n),
top AS (SELECT d AS root, h AS height FROM outer_tree WHERE n = 1),
inner_path AS (SELECT p.lang, p.pos, list(CASE WHEN t.d IS NULL THEN '-' WHEN (p.pos >> s.h) & 1 = 1 THEN 'L' || t.d ELSE 'R' || t.d END ORDER BY s.h) AS path
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang, LATERAL (SELECT unnest(range(r.height)) AS h) s
  LEFT JOIN inner_tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.h = s.h AND t.pos = xor(p.pos >> s.h, 1) GROUP BY p.lang, p.pos),
outer_path AS (SELECT p.lang, list(CASE WHEN t.d IS NULL THEN '-' WHEN (p.place >> s.h) & 1 = 1 THEN 'L' || t.d ELSE 'R' || t.d END ORDER BY s.h) AS path
  FROM subroots p, top, LATERAL (SELECT unnest(range(top.height)) AS h) s LEFT JOIN outer_tree t ON t.h = s.h AND t.pos = xor(p.place >> s.h, 1) GROUP BY p.lang),
whole AS (SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS own, r.subroot, top.root, list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN top
  LEFT JOIN inner_path i ON p.lang IS NOT DISTINCT FROM i.lang AND p.pos = i.pos LEFT JOIN outer_path o ON p.lang IS NOT DISTINCT FROM o.lang),
folded AS (SELECT *, list_reduce(list_prepend(own, path), lambda x, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || x) WHEN 'R' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query(OP13_SQL)
def op13_path_copying(spark, sf) -> DataFrame:
    """Operator 13: manifest of all documents, and for each the root after its tampering."""
    from .manifest import manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf, "documents"), tampered, {"n_chars": F.try_add("n_chars", F.lit(1))})
