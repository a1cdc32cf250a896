"""Queries of the operators on the tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (
    bpe, divergence, exact_dedup, html_text, langid, merkle, mixing, pii, quality_classifier, quality_rules, secret_scan, simhash,
    toxicity,
)
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mix_sources, op3_byte_bpe, op4_quality_classifier, op5_exact_dedup, op6_quality_rules,
        op7_html_text, op8_secret_scan, op9_simhash, op10_pii, op11_toxicity, op12_merkle_manifest, op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op2_mix_sources": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
          FROM documents),
        s AS (
          SELECT *, CASE (src_no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap
          FROM (SELECT source, sum(size)::BIGINT AS source_size,
                       row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM d GROUP BY source)),
        b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
        l AS (
          SELECT s.*, ((SELECT budget FROM b) - coalesce(sum(cap) OVER e, 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
          FROM s WINDOW e AS (ORDER BY cap / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
          SELECT l.*, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE weight *
                 (SELECT arg_min(level, (cap / weight, src_no)) FROM l WHERE cap > weight * level) END AS target
          FROM l),
        q AS (
          SELECT d.*, t.src_no, t.source_size, t.target, t.weight, sum(d.size) OVER (
                 PARTITION BY t.src_no ORDER BY k, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        i AS (
          SELECT q.*, e, ((cum + e * source_size) / weight)::DOUBLE AS finish FROM q, (VALUES (0), (1)) AS r(e)),
        r AS (
          SELECT i.*, sum(size) OVER (ORDER BY finish, src_no, e, k, doc_id, size ROWS UNBOUNDED PRECEDING)
                 <= (SELECT budget FROM b) AS taken FROM i)
        SELECT doc_id, size, source_size, target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken
        FROM r GROUP BY doc_id, k, size, source_size, target, cum
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS id, *,
            list_reduce(
              list_concat([4294967295::BIGINT], list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
                lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
              lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
          FROM documents),
        f AS (
          SELECT id, doc_id, source,
            concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
            text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
          FROM d),
        leaf AS (
          SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other
          FROM f),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS ix, count(*) OVER (PARTITION BY source) AS n,
                 dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
          FROM leaf),
        low(tree, level, ix, digest, n) AS (
          SELECT tree, 0, ix, leaf, n FROM placed
          UNION ALL
          SELECT tree, level + 1, ix // 3, sha256(string_agg(digest, '' ORDER BY ix)), (n + 2) // 3 FROM low WHERE n > 1
          GROUP BY tree, level, ix // 3, n),
        subroots AS (SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM low GROUP BY tree),
        high(level, ix, digest, n) AS (
          SELECT 0, tree, subroot, (SELECT count(*) FROM subroots) FROM subroots
          UNION ALL
          SELECT level + 1, ix // 3, sha256(string_agg(digest, '' ORDER BY ix)), (n + 2) // 3 FROM high WHERE n > 1
          GROUP BY level, ix // 3, n),
        top AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM high),
        steps AS (
          SELECT p.id, s.level AS step,
                 coalesce(string_agg(s.digest, '' ORDER BY s.ix) FILTER (s.ix < p.ix // pow(3, s.level)::BIGINT), '') AS before,
                 coalesce(string_agg(s.digest, '' ORDER BY s.ix) FILTER (s.ix > p.ix // pow(3, s.level)::BIGINT), '') AS after
          FROM placed p JOIN low s ON s.tree = p.tree AND s.n > 1 AND s.ix // 3 = p.ix // pow(3, s.level + 1)::BIGINT
          GROUP BY p.id, s.level
          UNION ALL
          SELECT p.id, r.height + h.level,
                 coalesce(string_agg(h.digest, '' ORDER BY h.ix) FILTER (h.ix < p.tree // pow(3, h.level)::BIGINT), ''),
                 coalesce(string_agg(h.digest, '' ORDER BY h.ix) FILTER (h.ix > p.tree // pow(3, h.level)::BIGINT), '')
          FROM placed p JOIN subroots r ON r.tree = p.tree JOIN high h ON h.n > 1 AND h.ix // 3 = p.tree // pow(3, h.level + 1)::BIGINT
          GROUP BY p.id, r.height + h.level),
        proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS last FROM steps GROUP BY id),
        walk(id, step, digest) AS (
          SELECT id, 0, other FROM placed
          UNION ALL
          SELECT w.id, w.step + 1, sha256(s.before || w.digest || s.after) FROM walk w JOIN steps s ON s.id = w.id AND s.step = w.step),
        ends AS (SELECT id, arg_max(digest, step) AS folded FROM walk GROUP BY id)
        SELECT p.doc_id, p.leaf, r.subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = t.root AS verified
        FROM placed p JOIN subroots r ON r.tree = p.tree CROSS JOIN top t LEFT JOIN proofs q ON q.id = p.id JOIN ends e ON e.id = p.id
    """,
    "op13_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
          FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gt AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        lt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
        lv AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang),
        p AS (
          SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * v.v) AS p
          FROM gt JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lt.n + 2)) // (lv.total + 2 * v.v) AS q FROM lt JOIN lv USING (lang) JOIN v USING (lang)),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
