"""The registered queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import scratch
from .chat import CONTROL, canonical_turns, format_turns, read_back, row_records
from .chunk_fingerprint import compare_edited
from .class_lm import score_documents
from .exact_dedup import exact_dedup
from .license_scan import scan_licenses
from .mixing import mix
from .quality import quality_scores
from .ranked_search import ranked_search
from .simhash import simhash_components
from .spelling import LEAST_COUNT, spelling_groups, word_counts
from .token_counts import token_counts
from .token_files import read_checksums, write_token_files
from .tokens import encode_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(canonical_turns(row_records(rows.unionByName(more)), "conv_id", "record")))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    docs = _table(spark, sf_dir, "documents")
    write_token_files(docs, folder)
    return read_checksums(spark, folder, id_type=docs.schema["doc_id"].dataType.simpleString())


def misspelt(doc: object, word: bytes) -> str:
    """The word, or in one of 199 documents the word without one of its code points, which the same hash chooses."""
    h = zlib.crc32(word, zlib.crc32(f"{'' if doc is None else doc}:".encode()))
    text = word.decode()
    return text if h % 199 else text[: h % len(text)] + text[h % len(text) + 1 :]


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(_table(spark, sf_dir, "documents"), change=misspelt)
    return spelling_groups(words.filter(F.col("n") >= LEAST_COUNT))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_mixing, op4_quality, op5_bpe, op6_token_counts, op7_fingerprint, op8_class_lm, op9_simhash, op10_chat, op11_token_files, op12_spelling, op13_ranked_search)}

_CONTROL = "|".join(re.sub(r"([\[\]|/])", r"\\\1", c) for c in CONTROL)

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op10_chat": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, 17 + length(role) + length(text) + length(text) - length(replace(text, '\', '')) + 2 * len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        s AS (SELECT count(*) AS nn, CAST(sum(len(words)) AS BIGINT) AS ll FROM d WHERE len(words) > 0),
        q AS (SELECT item_id, term, count(*) AS qtf FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        r AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
              FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
