"""JSON payloads: operations that a synthesiser returns, and redaction of nested secrets."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SENSITIVE, strip_code_fence

ACTIONS = {"CREATE_OR_UPDATE": "content", "DELETE": "reason"}
OPERATIONS = "array<struct<action:string,path:string,content:string,reason:string>>"


def operations(payload: Column) -> Column:
    """struct<operations,valid>: the operations of a payload, with or without a code fence. Valid is only what is one JSON object
    and nothing else, whose operations all have a known action, a path that isn't empty, and what the action needs (content of a page to write, the reason of
    a removal), each a string. A payload that isn't valid has no operations."""
    bare = strip_code_fence(payload)
    # With its own digest behind it in one array, nothing that follows the object goes unnoticed.
    seal = F.sha2(bare, 256)
    sealed = F.try_parse_json(F.concat(F.lit("["), bare, F.lit(',"'), seal, F.lit('"]')))
    whole = (F.try_variant_get(sealed, "$[1]", "string") == seal) & F.try_variant_get(sealed, "$[2]", "variant").isNull() & bare.startswith("{") & bare.endswith("}")
    listed = F.try_variant_get(sealed, "$[0].operations", "array<variant>")
    text = lambda o, key: F.when(F.schema_of_variant(F.try_variant_get(o, f"$.{key}", "variant")) == "STRING", F.try_variant_get(o, f"$.{key}", "string"))
    read = F.transform(listed, lambda o: F.struct(*(text(o, k).alias(k) for k in ("action", "path", "content", "reason"))))
    good = F.forall(read, lambda o: F.coalesce((o["path"] != "") & reduce(or_, ((o["action"] == a) & o[need].isNotNull() for a, need in ACTIONS.items())), F.lit(False)))
    valid = F.coalesce(whole & listed.isNotNull() & good, F.lit(False))
    return F.struct(F.when(valid, read).alias("operations"), valid.alias("valid"))


def _clean(value):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in SENSITIVE) else _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def redact(payload: pd.Series) -> pd.Series:
    """JSON with the values of sensitive keys replaced at any depth; text that isn't JSON becomes null, null stays null.

    Depth is unbounded, which column expressions can't follow: hence Arrow batches."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_clean(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return payload.map(one)
