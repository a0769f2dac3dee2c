"""The queries of this subpackage, one for each operator, over their whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import chat, decontaminate, langid, lexical, lm_score, ngram_join, pieces, quality, repair, secrets, topk, toxicity, warc
from stratalens.llm.common import read
from stratalens.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """A tokenizer file's place on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.tokenize(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces.model_bytes(public_model()))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"), secrets.new_ledger(spark))


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(read(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, :said AS text UNION ALL SELECT -1L, 1L, 'assistant', :said", args={"said": said})
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary = pieces.model_bytes(public_model("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    return chat.read_back(chat.formatted(turns, *vocabulary), *vocabulary)


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(read(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.rules(docs, quality.fit(docs, read(spark, sf_dir, "labels"))).drop("content_lines")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(turns), turns)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op13_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, len(terms) AS n, terms FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
 size AS (SELECT count(*) AS docs, sum(n) AS terms FROM docs),
 asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, item_id, term),
 held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
 weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), size),
 scores AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
   FROM asked JOIN held USING (term) JOIN weights USING (term), size GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


_WHITE = r"\x20\x09-\x0D"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
#: CRC-32 of an ASCII text, bit by bit
_CRC = f"""xor(list_reduce(list_transform(range(1, length({_KEY}) + 1), lambda i: CAST(ascii(({_KEY})[i]) AS BIGINT)), lambda c, b:
  list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"""


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _put(state: str, cost: str, letter: str, said: str | None = None) -> str:
    said = "" if said is None else f" || chr(10) || {said}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{said}}}"


_NEVER = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
_USER, _ASSISTANT, _OWN = "'user:'", "'assistant:'", "role || ':' || said"


def _turn(state: str, initial: str, said: str) -> str:
    """A row that is kept, if it has that initial, or reroled, if it may stay."""
    stays = "CASE WHEN cut THEN 5 ELSE 0 END"
    kept = f"CASE WHEN NOT must_go AND substr(role, 1, 1) = '{initial}' THEN {_put(state, stays, 'K', _OWN)} ELSE {_NEVER} END"
    return kept if initial == "s" else kept + f", CASE WHEN NOT must_go THEN {_put(state, '1 + ' + stays, 'R', said + ' || said')} ELSE {_NEVER} END"


ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS said,
   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
   FROM (SELECT *, {_CRC} % 20 AS kind FROM conversations) WHERE kind <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(said)) AS i,
   NOT regexp_matches(said, '[^{_WHITE}]') AS blank, NOT regexp_matches(said, '[.!?][{_WHITE}]*$') AS cut FROM damaged),
 told AS (SELECT *, blank OR row_number() OVER (PARTITION BY conv_id, role, said ORDER BY i) > 1 AS must_go,
   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (must_go AND NOT blank) AS duplicate,
   count(*) FILTER (cut AND NOT must_go) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY conv_id),
 every AS (SELECT DISTINCT conv_id FROM conversations),
 walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS b0, {_NEVER} AS b1, {_NEVER} AS b2, {_NEVER} AS b3 FROM every
  UNION ALL
  SELECT conv_id, i, {_put('b0', '2', 'D')}, {_least(_put('b1', '2', 'D'), _turn('b0', 's', ''))},
   {_least(_put('b2', '2', 'D'), *[_turn(b, 'u', _USER) for b in ('b0', 'b1', 'b3')])}, {_least(_put('b3', '2', 'D'), _turn('b2', 'a', _ASSISTANT))}
  FROM (SELECT conv_id, i, role, said, cut, must_go, b0, b1, {_least('b2', _put('b3', '5', 'I', _USER))} AS b2, {_least('b3', _put('b2', '5', 'I', _ASSISTANT))} AS b3
   FROM (SELECT told.conv_id, told.i, role, said, cut, must_go, b0, b1, {_least('b2', *[_put(b, '5', 'I', _USER) for b in ('b0', 'b1', 'b3')])} AS b2, b3
    FROM walk JOIN told ON told.conv_id IS NOT DISTINCT FROM walk.conv_id AND told.i = walk.i + 1))),
 ended AS (SELECT walk.conv_id, {_least('b0', 'b3', _put('b2', '5', 'I', _ASSISTANT), _put('b1', '10', 'II', _USER + " || chr(10) || " + _ASSISTANT))} AS b
  FROM walk LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE i = coalesce(n, 0))
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id"""
