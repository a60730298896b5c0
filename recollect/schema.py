"""Column names, declared input layouts, column groups and shared key spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column codes found in stored feature files and the readable names used here.
SOURCE_NAMES = {
    "label_0": "label_0",
    "129_1": "uid",
    "130_1": "u1",
    "130_2": "u2",
    "130_3": "u3",
    "130_4": "u4",
    "130_5": "u5",
    "150_2_180": "hist_items",
    "151_2_180": "hist_cates",
    "150_1_180": "short_items",
    "151_1_180": "short_cates",
    "205": "iid",
    "206": "cate",
    "213": "i1",
    "214": "i2",
    "205_c": "iid_c",
    "150_2_180_c": "hist_items_c",
    "150_1_180_c": "short_items_c",
}

# Sequence and search sizes used when the caller gives none.
MAX_SEQ_LEN = 1000
SHORT_LEN = 50
KEEP_TOP = 50
VECTOR_WIDTH = 128
ROWS_PER_SHARD = 500_000
ROWS_PER_ROW_GROUP = 10_000
COVERAGE_LEVELS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)

USER_ATTRIBUTES = ["u1", "u2", "u3", "u4", "u5"]
USER_COLUMNS = ["uid", *USER_ATTRIBUTES]
ITEM_COLUMNS = ["iid", "cate", "i1", "i2"]
HISTORY_COLUMNS = ["hist_items", "hist_cates"]
SAMPLE_COLUMNS = [
    "label_0", "uid", *USER_ATTRIBUTES, *HISTORY_COLUMNS, *ITEM_COLUMNS,
]

COLUMN_GROUPS = {
    "target": ["iid", "cate", "i1", "i2", "iid_c"],
    "user": USER_COLUMNS,
    "long": ["hist_items", "hist_cates", "hist_items_c"],
    "short": ["short_items", "short_cates", "short_items_c"],
}

# Features whose ids live in the vocabulary of another feature.
SHARED_VOCABULARY = {
    "iid": "hist_items",
    "short_items": "hist_items",
    "cate": "hist_cates",
    "short_cates": "hist_cates",
}
VOCABULARIES = ["i1", "i2", *USER_COLUMNS, *HISTORY_COLUMNS]

# Declared text layouts: (field, role). Roles: labels, ids, id, vector.
LAYOUTS = {
    "samples": [("label_0", "labels"), ("uid", "id"), ("iid", "id")],
    "items": [("iid", "id"), ("cate", "id"), ("i1", "id"), ("i2", "id")],
    "users": [(c, "id") for c in USER_COLUMNS] + [(c, "ids") for c in HISTORY_COLUMNS],
    "embeddings": [("iid", "id"), ("vec", "vector")],
}

ROLE_TYPES = {
    "labels": T.ArrayType(T.ByteType()),
    "ids": T.ArrayType(T.LongType()),
    "id": T.LongType(),
    "vector": T.ArrayType(T.FloatType()),
}

# Split names and the tables each one is built from.
SPLIT_TABLES = {
    mode: (f"{mode}_samples", f"{mode}_user_features", "item_features")
    for mode in ("train", "test")
}


def vocabulary_of(feature: str) -> str:
    """Vocabulary in which a feature's ids are indexed."""
    return SHARED_VOCABULARY.get(feature, feature)


def layout_schema(layout: list[tuple[str, str]]) -> T.StructType:
    """Spark schema of a declared layout."""
    return T.StructType([T.StructField(name, ROLE_TYPES[role]) for name, role in layout])


def to_readable(df: DataFrame) -> DataFrame:
    """Rename stored column codes to readable names; other columns are kept."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_NAMES.items() if k in df.columns})


def to_source(df: DataFrame) -> DataFrame:
    """Rename readable names back to stored column codes."""
    codes = {v: k for k, v in SOURCE_NAMES.items()}
    return df.withColumnsRenamed({k: v for k, v in codes.items() if k in df.columns})


def group_columns(df: DataFrame, group: str) -> DataFrame:
    """Columns of one named group."""
    return df.select(*COLUMN_GROUPS[group])

# Partition of a table made from text: good rows and rejected lines.
LINE_KIND = "line_kind"
