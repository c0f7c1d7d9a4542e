"""Canonical views of retrieval and operations data, derived from the raw tables.

The raw tables hold no tenants, chunks, jobs or labels; the derivations here are fixed
rules, and `SQL` states the same rules for DuckDB.  `AS_OF` stands for now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
# The document types, the search modes, the stages of ingest in order.
DOC_TYPES = ["pdf", "hwp", "hwpx", "docx", "pptx", "image", "url", "txt", "md"]
MODES = ["hybrid", "dense", "sparse"]
STAGES = ["extract", "chunk", "chunk_filter", "content_gate", "tag_summarize", "load", "embed", "doc_embed", "dedup"]
CHUNK_CHARS = 800
#: Queries and comments that reach every branch of the rules of query understanding.
ASKS = [
    "자료랑 규정 문서", "이력서와 계약서 A", "매뉴얼들 중에서 찾기", "A안과 B안 차이", "가격 비교", "ISO vs KS", "다르게 적힌 부분", "왜 늦었나", "지연 이유",
    "바뀐 규정", "변경 내역", "그때 본 표", "어디였더라 그 파일", "사과과 배랑 귤랑 감", "2024년 1월 3일 회의록", "2024-01-05 보고서 보여줘", "2024년 1월", "어제 받은 문서",
    "#en 문서", "#fr", "#en #src1 어떻게 계산", "프로젝트 X 기획서를 찾아줘", "결론", "구조도 그림", "별표 목록", "지원금 얼마", "3 개월 이내", "몇 명", "핵심 요약",
    "기억나 그 사진", "개인정보 처리", "색상 선택", "시트 종류", "하나 둘 셋 넷 다섯 여섯 문서", "지난주 #src2", "2024-13-45 파일",
    "아주 긴 질문으로서 여러 낱말을 하나씩 이어서 적어 마흔 글자를 넘기고 끝내 뭐였지 하고 다시 묻는 글", "한 두 세 네 다 여 일 여 아 열 십 백 천", "", "   ",
]
COMMENTS = ["출처가 이상함", "근거 없음", "검색이 안 됨", "chunk 가 다름", "답변이 틀린 것", "환각 같음", "좋아요", "", "  ", None]


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _pick(values: list[str], index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        d = self.table("documents")
        created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 3600)
        return d.select(
            "doc_id",
            F.col("source").alias("user_id"),
            F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")).alias("title"),
            _pick(DOC_TYPES, F.col("doc_id")).alias("doc_type"),
            F.array("lang", "source").alias("tags"),
            created.alias("created_at"),
            F.when(F.col("doc_id") % 17 == 0, created).alias("deleted_at"),
            (F.col("doc_id") % 23 == 0).alias("failed"),
            (F.col("doc_id") % 5 == 0).alias("scan"),
            (F.col("n_chars") * 20000).alias("size_bytes"),
            F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 4000).alias("received_ms"),
            "text",
        )

    def chunks(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "text")
        n = F.ceil(F.char_length("text") / CHUNK_CHARS).cast("int")
        at = d.filter(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
        return at.select(
            (F.col("doc_id") * 1_000_000 + F.col("chunk_idx")).alias("chunk_id"),
            "doc_id",
            "chunk_idx",
            F.substring("text", F.col("chunk_idx") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("text"),
            (F.floor(F.col("chunk_idx") / 3) + 1).cast("int").alias("page"),
        )

    def vecs(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))

    def queries(self) -> DataFrame:
        b, e = self.table("benchmark"), self.vecs()
        return b.join(e, b["item_id"] == e["doc_id"]).select(F.col("item_id").alias("query_id"), "text", "vec")

    def search_log(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").alias("recorded_at"),
            F.col("value").alias("took_ms"),
            _pick(MODES, F.col("event_id")).alias("mode"),
            F.when(F.col("event_type") == "error", "transient_5xx").alias("fallback_reason"),
            F.get_json_object("props", "$.k").cast("int").alias("fused"),
            (F.col("event_id") % 2 == 0).alias("cache_hit"),
        )

    def usage(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").alias("called_at"),
            F.col("user_id").alias("user_key"),
            (F.col("event_type") != "error").alias("success"),
            (F.col("value") / 100000).alias("cost"),
            F.col("user_id").alias("doc_id"),
            F.get_json_object("props", "$.k").cast("int").alias("page"),
            "event_type",
        )

    def jobs(self) -> DataFrame:
        status = F.create_map(*[F.lit(x) for kv in (("view", "queued"), ("click", "running"), ("signup", "completed"), ("purchase", "failed"), ("error", "cancelled")) for x in kv])
        return self.table("events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("doc_id"), status[F.col("event_type")].alias("status"), F.col("ts").alias("queued_at"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("started_at"))

    def stage_logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("log_id"),
            F.col("user_id").alias("job_id"),
            _pick(STAGES, F.col("event_id")).alias("stage"),
            F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("succeeded").alias("status"),
            (F.floor(F.col("value") * 10)).cast("long").alias("duration_ms"),
            F.col("ts").alias("started_at"),
        )

    def feedback(self) -> DataFrame:
        comments = self.table("conversations").filter("turn = 0").select("conv_id", F.col("text").alias("comment"))
        labels = self.table("labels")
        created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 3600)
        return labels.join(comments, labels["doc_id"] == comments["conv_id"], "left").select("doc_id", created.alias("created_at"), (F.col("quality") == 1).alias("helpful"), "comment")

    def asks(self) -> DataFrame:
        """(ask_id, text, source, negative): one query for each document; `source` is what its document says."""
        i = F.col("doc_id")
        source = F.when(i % 3 == 0, "비식별화 규정").when(i % 3 == 1, "컬러와 가죽")
        return self.table("documents").select(i.alias("ask_id"), _pick(ASKS, i).alias("text"), source.alias("source"), (i % 37 == 0).alias("negative"))

    def comments(self) -> DataFrame:
        """(doc_id, helpful, comment) of every judged document."""
        return self.table("labels").select("doc_id", (F.col("quality") == 1).alias("helpful"), _pick(COMMENTS, F.col("doc_id")).alias("comment"))

    def subscriptions(self) -> DataFrame:
        c = self.table("customer")
        plan = _pick(["free", "starter", "pro"], F.col("c_custkey"))
        status = _pick(["active", "past_due", "canceled", "trialing"], F.col("c_custkey"))
        end = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("c_custkey") % 60) * 86400)
        return c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), plan.alias("plan"), status.alias("status"), end.alias("period_end"))


#: The same views for DuckDB.
SQL = f"""
asks AS (
  SELECT doc_id AS ask_id, [{', '.join(map(_text, ASKS))}][(doc_id % {len(ASKS)} + 1)::INT] AS text,
    CASE doc_id % 3 WHEN 0 THEN '비식별화 규정' WHEN 1 THEN '컬러와 가죽' END AS source, doc_id % 37 = 0 AS negative FROM documents
), comments AS (
  SELECT doc_id, quality = 1 AS helpful, [{', '.join(map(_text, COMMENTS))}][(doc_id % {len(COMMENTS)} + 1)::INT] AS comment FROM labels
), docs AS (
  SELECT doc_id, source AS user_id, lang || '_' || source || '_' || doc_id AS title,
    ['pdf','hwp','hwpx','docx','pptx','image','url','txt','md'][(doc_id % 9 + 1)::INT] AS doc_type, [lang, source] AS tags,
    TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) END AS deleted_at,
    doc_id % 23 = 0 AS failed, doc_id % 5 = 0 AS scan, n_chars * 20000 AS size_bytes,
    CASE WHEN doc_id % 11 <> 0 THEN n_chars % 4000 END AS received_ms, text
  FROM documents
), chunks AS (
  SELECT doc_id * 1000000 + i AS chunk_id, doc_id, i::INT AS chunk_idx, substr(text, i * 800 + 1, 800) AS text, (i // 3 + 1)::INT AS page
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 799) // 800)) AS i FROM documents)
), vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec FROM embeddings),
queries AS (SELECT item_id AS query_id, text, vec FROM benchmark JOIN vecs ON item_id = doc_id),
search_log AS (
  SELECT event_id, ts AS recorded_at, value AS took_ms, ['hybrid','dense','sparse'][(event_id % 3 + 1)::INT] AS mode,
    CASE WHEN event_type = 'error' THEN 'transient_5xx' END AS fallback_reason, (props->>'$.k')::INT AS fused, event_id % 2 = 0 AS cache_hit
  FROM events
), usage AS (
  SELECT event_id, ts AS called_at, user_id AS user_key, event_type <> 'error' AS success, value / 100000 AS cost, user_id AS doc_id, (props->>'$.k')::INT AS page, event_type FROM events
), jobs AS (
  SELECT event_id AS job_id, user_id AS doc_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'failed' WHEN 'error' THEN 'cancelled' END AS status,
    ts AS queued_at, CASE WHEN event_id % 10 <> 0 THEN ts END AS started_at FROM events
), stage_logs AS (
  SELECT event_id AS log_id, user_id AS job_id, ['extract','chunk','chunk_filter','content_gate','tag_summarize','load','embed','doc_embed','dedup'][(event_id % 9 + 1)::INT] AS stage,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'succeeded' END AS status, floor(value * 10)::BIGINT AS duration_ms, ts AS started_at FROM events
), feedback AS (
  SELECT doc_id, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at, quality = 1 AS helpful, c.text AS comment
  FROM labels LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) c ON doc_id = conv_id
), subscriptions AS (
  SELECT c_custkey AS user_id, ['free','starter','pro'][(c_custkey % 3 + 1)::INT] AS plan, ['active','past_due','canceled','trialing'][(c_custkey % 4 + 1)::INT] AS status,
    TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) AS period_end FROM customer WHERE c_custkey % 7 <> 0
)
"""


def sql(body: str, *more: str) -> str:
    """DuckDB SQL with the views, and further common tables, in front of `body`."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body
