"""Explicit schemas of the engine's tables. List columns are arrays; newline lists exist only at import and export."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_LIST = T.ArrayType(_S, False)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


JAVA_BLOB_INDEX = _table(
    id=_L, repository_name=_S, blob_object_id=_S, commit_object_id=_S, file_type=_S, file_path=_S, package_name=_S, declared_types=_LIST, fully_qualified_names=_LIST, declared_methods=_LIST,
    declared_fields=_LIST, extends_types=_LIST, implements_types=_LIST, import_statements=_LIST, source_snippet=_S, project_name=_S, simple_class_name=_S, type_kind=_S, visibility=_S,
    annotations=_LIST, line_count=_I, type_documentation=_S, method_signatures=_LIST, referenced_types=_LIST, string_literals=_LIST, has_main_method=_B, commit_author=_S, commit_date=_TS,
    semantic_embedding=T.ArrayType(T.FloatType(), False), has_embedding=_B,
)
GIT_COMMIT_INDEX = _table(repository_name=_S, object_id=_S, commit_message=_S, author_name=_S, author_email=_S, commit_time=_TS, parent_ids=_LIST, changed_paths=_LIST)
FILE_PATH_HISTORY = _table(repository_name=_S, commit_object_id=_S, file_path=_S, blob_object_id=_S, file_type=_S, commit_time=_TS)
GIT_OBJECTS = _table(object_id=_S, object_type=_I, object_size=_L, data=T.BinaryType(), repository_name=_S, created_at=_TS)
GIT_PACKS = _table(repository_name=_S, pack_name=_S, pack_extension=_S, data=T.BinaryType(), file_size=_L, created_at=_TS)
GIT_REFS = _table(version=_L, repository_name=_S, ref_name=_S, object_id=_S, symbolic_target=_S, is_peeled=_B, peeled_object_id=_S, updated_at=_TS)
GIT_REFLOG = _table(id=_L, version=_L, repository_name=_S, ref_name=_S, old_id=_S, new_id=_S, who_name=_S, who_email=_S, who_when=_TS, message=_S)
COMMIT_EVALUATION = _table(
    commitHash=_S, commitMessage=_S, repoUrl=_S, evaluatedAt=_TS, commitDate=_TS, relevant=_B, irrelevantReason=_S, isDuplicate=_B, duplicateOf=_S, reusability=_I, codeImprovement=_I,
    implementationEffort=_I, trafficLight=_S, category=_S, isNewCategory=_B, categoryReason=_S, canImplementInCurrentDsl=_B, dslRule=_S, targetHintFile=_S, languageChangeNeeded=_S,
    dslRuleAfterChange=_S, summary=_S, dslValidationResult=_S, beforeExample=_S, afterExample=_S, negativeExample=_S, sourceVersion=_S,
)
MATCH_ENTRY = _table(repo=_S, hint_file=_S, rule_name=_S, file_path=_S, line=_I, matched_code=_S, suggested_replacement=_S)
MATCH_SCORE = _table(trivial_change=_I, null_status=_S, severity=_S, reason=_S, evidence=_LIST)
SCORED_MATCH = T.StructType([*MATCH_ENTRY.fields, T.StructField("score", MATCH_SCORE)])
MINING_CANDIDATE = _table(
    id=_S, schemaVersion=_I, revision=_I, candidateOrdinal=_I, dslRule=_S, beforeExample=_S, afterExample=_S, negativeExample=_S, targetHintFile=_S, sourceCommit=_S, sourceRepo=_S, category=_S,
    summary=_S, sourceVersion=_S, status=_S, discoveredAt=_S, transitions=T.ArrayType(_table(at=_S, source=_S, target=_S, note=_S)),
)
FLOW_NODE = _table(canonical_id=_S, unit=_S, kind=_S, name=_S, start=_I, length=_I, status=_S)
FLOW_EDGE = _table(unit=_S, src=_S, dst=_S, kind=_S, start=_I)
AST_NODE = _table(file_id=_L, node_id=_I, parent_id=_I, ordinal=_I, kind=_S, text=_S, start=_I, end=_I, line=_I)


def split_lines(c) -> Column:
    """A newline-joined list as an array; null and empty give an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))


def join_lines(c) -> Column:
    return F.array_join(c, "\n")
