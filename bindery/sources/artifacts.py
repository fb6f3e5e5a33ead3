"""JSON artifacts: canonical review and plan exports, their inspection, journals and histories."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..functions.digests import field16, fold

REVIEW_SCHEMA, PLAN_SCHEMA = "recommendation-review/1.0", "cleanup-plan/1.0"
#: Bounds of an artifact (fixed values).
BOUNDS = {"depth": 64, "rows": 100_000, "issues": 10_000, "bytes": 64 << 20, "line": 1_000_000}
#: Shapes that a review artifact must have, in the order in which they are checked (fixed codes).
REVIEW_CODES = ["MALFORMED_JSON", "UNSUPPORTED_SCHEMA_VERSION", "UNSUPPORTED_MODEL_VERSION", "INVALID_SOURCE", "INVALID_GROUPS", "INVALID_GROUP_ID", "INVALID_MEMBERS", "INVALID_MEMBER", "UNSAFE_RELATIVE_PATH", "INVALID_RECOMMENDATION", "INVALID_FORMAT_SELECTION", "INVALID_RECORD_SELECTION", "INVALID_OVERRIDE"]


def canonical_json(columns: list[str]) -> Column:
    """The row as JSON with its fields in the given order; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def export(rows: DataFrame, path: str, schema: str, key: str = "group_id") -> None:
    """JSON Lines in key order, one object per row behind the schema's name: the same rows give the same bytes.

    Rows are sorted by range, so the export is spread over files whose names follow the order.
    """
    columns = ["schema", *rows.columns]
    ordered = rows.withColumn("schema", F.lit(schema)).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.select(canonical_json(columns).alias("value")).write.mode("overwrite").text(path)


class Duplicate(ValueError):
    pass


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Duplicate("a property occurs twice")
    return out


def _depth(value) -> int:
    most, front = 0, [(value, 1)]
    while front:
        at, depth = front.pop()
        most = max(most, depth)
        if isinstance(at, (dict, list)):
            front += [(x, depth + 1) for x in (at.values() if isinstance(at, dict) else at)]
    return most


def parse(text: str | None):
    """The value of a JSON text within all bounds, else a ValueError."""
    if text is None or len(text.encode()) > BOUNDS["bytes"]:
        raise ValueError("no text, or too long")
    try:
        value = json.loads(text, object_pairs_hook=_unique)
    except RecursionError as e:
        raise ValueError("too deep") from e
    if _depth(value) > BOUNDS["depth"]:
        raise ValueError("too deep")
    return value


def _unsafe(path) -> bool:
    return not isinstance(path, str) or not path or path[0] in "/\\" or ":" in path or ".." in path.replace("\\", "/").split("/")


def review_failure(text: str | None) -> str | None:
    """The first of REVIEW_CODES that a review artifact fails with, or None."""
    try:
        doc = parse(text)
    except ValueError:
        return "MALFORMED_JSON"
    if not isinstance(doc, dict):
        return "MALFORMED_JSON"
    if doc.get("schema") != REVIEW_SCHEMA:
        return "UNSUPPORTED_SCHEMA_VERSION"
    if not isinstance(doc.get("model"), str) or not doc["model"].startswith("1."):
        return "UNSUPPORTED_MODEL_VERSION"
    if not isinstance(doc.get("source"), dict) or not doc["source"].get("library_uuid"):
        return "INVALID_SOURCE"
    groups = doc.get("groups")
    if not isinstance(groups, list) or len(groups) > BOUNDS["rows"]:
        return "INVALID_GROUPS"
    seen = set()
    for group in groups:
        name = group.get("group_id") if isinstance(group, dict) else None
        if not isinstance(name, str) or not name.strip() or name in seen:
            return "INVALID_GROUP_ID"
        seen.add(name)
        members = group.get("members")
        if not isinstance(members, list) or len(members) < 2 or len(members) > BOUNDS["rows"]:
            return "INVALID_MEMBERS"
        for member in members:
            if not isinstance(member, dict) or not isinstance(member.get("book_id"), int) or not isinstance(member.get("formats"), list):
                return "INVALID_MEMBER"
            if any(_unsafe(f.get("path") if isinstance(f, dict) else None) for f in member["formats"]):
                return "UNSAFE_RELATIVE_PATH"
        if group.get("status") not in ("Recommended", "RetainedSeparate", "Unsupported"):
            return "INVALID_RECOMMENDATION"
        if not isinstance(group.get("selections"), list) or any(not isinstance(s, dict) or not s.get("format") for s in group["selections"]):
            return "INVALID_FORMAT_SELECTION"
        ids = {m["book_id"] for m in members}
        if group.get("metadata_source") is not None and group["metadata_source"] not in ids:
            return "INVALID_RECORD_SELECTION"
        review = group.get("override")
        if review is not None and (not isinstance(review, dict) or review.get("action") not in ("SelectSource", "MarkUnresolved", "ExcludeFinalFormat", "KeepSeparate", "NotDuplicates", "Defer")):
            return "INVALID_OVERRIDE"
    return None


@F.pandas_udf(StringType())
def _failure(text: pd.Series) -> pd.Series:
    return text.map(review_failure)


def inspect_reviews(texts: DataFrame) -> DataFrame:
    """(name, code) of review artifacts (name, text): the first failure, null for a sound one."""
    return texts.select("name", _failure("text").alias("code"))


#: The plan policy that can be carried out, the states of a plan and an artifact's properties (fixed values).
PLAN_POLICY, PLAN_STATES = "1.0", ("Draft", "Valid", "Blocked", "Approved", "Stale", "Revoked")
PLAN_FIELDS = {"schema": str, "policy": str, "group_id": int, "state": str, "instructions": list, "issues": list, "history": list, "digest": str}
INSTRUCTION = "kind string, book_id long, format string, reason string"


def _body_digest(doc: dict) -> str:
    """SHA-256 of a plan document without its digest, its properties in the order of their names."""
    body = {k: v for k, v in doc.items() if k != "digest"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@F.pandas_udf(StringType())
def _sealed(text: pd.Series) -> pd.Series:
    docs = text.map(json.loads)
    return docs.map(lambda doc: json.dumps(doc | {"digest": _body_digest(doc)}))


def plan_documents(plan: DataFrame, states: DataFrame) -> DataFrame:
    """(group_id, text): one sealed document a plan, from its instructions (group_id, kind, book_id, format, reason) and (group_id, state).

    The same rows give the same text.  A document is one value, as its readers need it;
    the bounds below are those of one plan.
    """
    rows = plan.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("kind", "book_id", "format", "reason"))).alias("instructions"))
    none = F.array().cast("array<string>")
    body = F.struct(F.lit(PLAN_SCHEMA).alias("schema"), F.lit(PLAN_POLICY).alias("policy"), "group_id", "state", "instructions", none.alias("issues"), none.alias("history"))
    return rows.join(states.select("group_id", "state"), "group_id").select("group_id", _sealed(F.to_json(body, {"ignoreNullFields": "false"})).alias("text"))


def plan_failure(text: str | None) -> str | None:
    """What a plan artifact fails with, or None: no schema, another schema, or anything malformed, out of bounds or altered."""
    try:
        doc = parse(text)
    except ValueError:
        return "CLEANUP_PLAN_JSON_INVALID"
    if not isinstance(doc, dict) or doc.get("schema") is not None and not isinstance(doc["schema"], str):
        return "CLEANUP_PLAN_JSON_INVALID"
    if doc.get("schema") is None:
        return "CLEANUP_PLAN_SCHEMA_REQUIRED"
    if doc["schema"] != PLAN_SCHEMA:
        return "UNSUPPORTED_CLEANUP_PLAN_SCHEMA"
    shaped = doc.keys() == PLAN_FIELDS.keys() and all(type(doc[k]) is kind for k, kind in PLAN_FIELDS.items()) and doc["state"] in PLAN_STATES
    if not shaped or len(doc["instructions"]) > BOUNDS["rows"] or max(len(doc["issues"]), len(doc["history"])) > BOUNDS["issues"]:
        return "CLEANUP_PLAN_JSON_INVALID"
    kinds = {"kind": str, "book_id": int, "format": (str, type(None)), "reason": str}
    sound = all(isinstance(i, dict) and i.keys() == kinds.keys() and all(isinstance(i[k], t) and not isinstance(i[k], bool) for k, t in kinds.items()) for i in doc["instructions"])
    return None if sound and doc["digest"] == _body_digest(doc) else "CLEANUP_PLAN_JSON_INVALID"


@F.pandas_udf(StringType())
def _plan_failure(text: pd.Series) -> pd.Series:
    return text.map(plan_failure)


def read_plans(texts: DataFrame) -> DataFrame:
    """(name, code, group_id, state, instructions) of plan artifacts (name, text); `code` is null for a sound one, the rest for any other.

    A sound plan of another policy is read as Blocked, whatever state it states.
    """
    shape = f"policy string, group_id long, state string, instructions array<struct<{INSTRUCTION}>>"
    judged = texts.select("name", "text", _plan_failure("text").alias("code"))
    doc = judged.withColumn("d", F.when(F.col("code").isNull(), F.from_json("text", shape)))
    state = F.when(F.col("d.policy") == PLAN_POLICY, F.col("d.state")).when(F.col("d").isNotNull(), "Blocked")
    return doc.select("name", "code", "d.group_id", state.alias("state"), "d.instructions")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Journal lines as the columns of `schema`, with `readable`: false for a line too long or not of that shape."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    shaped = lines.withColumn("j", F.when(F.length("value") <= BOUNDS["line"], parsed))
    names = [f.split()[0] for f in schema.split(", ")]
    first = F.col(f"j.{names[0]}")
    return shaped.select(*[F.col(f"j.{n}").alias(n) for n in names], F.coalesce(first.isNotNull(), F.lit(False)).alias("readable"))


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """History entries; one that cannot be read counts as recovery_required."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(path)
    return rows.withColumn("recovery_required", F.col("_corrupt").isNotNull()).drop("_corrupt")


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def manifest_digest(entries: DataFrame, key: str = "execution_id") -> DataFrame:
    """(key, digest) over backup entries (path, size, sha256) in path order."""
    line = F.concat(field16(F.col("path")), field16(F.col("size").cast("string")), field16(F.col("sha256")))
    return entries.groupBy(key).agg(fold(["path"], line).alias("digest"))


def seal_violations(sealed: DataFrame, reread: DataFrame, key: str = "execution_id") -> DataFrame:
    """Keys whose manifest, read again, does not have the sealed digest."""
    now = manifest_digest(reread, key).withColumnRenamed("digest", "now")
    return sealed.join(now, key, "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select(key)
