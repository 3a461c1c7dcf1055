"""JSON in the answers of language models: found, repaired, or null. Small helpers by row, applied in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?(.*?)```", re.S)


def _loads(text: str, kind: type):
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, kind) else None


def _balanced(text: str, opening: str, closing: str) -> list[str]:
    """The outermost stretches between the brackets, strings left aside."""
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = depth > 0
        elif c == opening:
            start = i if not depth else start
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def _candidates(text: str, *more: Callable[[], list[str]]) -> Iterator[str]:
    """The text, what is in its code fences, and ``more``; each is looked for only if those before could not be read."""
    yield text
    yield from _FENCE.findall(text)
    for found in more:
        yield from found()


def find_object(answer: str | None) -> str | None:
    """The object in the answer as JSON: as it stands, in a code fence, or between balanced braces; null if none can be read."""
    text = (answer or "").strip()
    for candidate in _candidates(text, lambda: [text.replace("```json", "").replace("```", "")], lambda: _balanced(text, "{", "}")):
        value = _loads(candidate.strip(), dict)
        if value is not None:
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def find_array(answer: str | None) -> str | None:
    """The array of objects in the answer; one that is cut off keeps its whole objects, and loose objects make an array."""
    text = (answer or "").strip()
    for candidate in _candidates(text, lambda: _balanced(text, "[", "]")):
        value = _loads(candidate.strip(), list)
        if value is not None:
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    whole = text[text.index("[") + 1 :] if "[" in text else text
    objects = [x for x in (_loads(o, dict) for o in _balanced(whole, "{", "}")) if x is not None]
    return json.dumps(objects, ensure_ascii=False, sort_keys=True) if objects else None


def find_checklist(answer: str | None, content: str | None) -> str:
    """Items and queries from the answer: direct, or between the first and last brace; else one item and one query from the content."""
    text, content = answer or "", content or ""
    value = _loads(text, dict)
    if value is None and "{" in text and "}" in text:
        value = _loads(text[text.index("{") : text.rindex("}") + 1], dict)
    if value is None:
        value = {"items": [{"number": "1", "name": content[:200]}], "queries": [content[:100]]}
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


#: Characters of answers, and rows, that a task has as Python strings at a time.
CHARS, ROWS = 1 << 20, 256


def _found(find: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """``find`` of every row of a batch; the answers are read and the results written a few at a time, so that only Arrow holds a whole batch."""
    size = reduce(pc.add, [pc.fill_null(pc.binary_length(c), 0).cast(pa.int64()) for c in columns])
    parts, row, ends = [], 0, np.cumsum(size.to_numpy(zero_copy_only=False))
    while row < len(ends):
        before = ends[row - 1] if row else 0
        end = max(row + 1, min(row + ROWS, int(np.searchsorted(ends, before + CHARS, "right"))))
        parts.append(pa.array([find(*(v.as_py() for v in values)) for values in zip(*(c.slice(row, end - row) for c in columns), strict=True)], pa.string()))
        row = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def object_in(answer: pa.Array) -> pa.Array:
    return _found(find_object, answer)


@F.arrow_udf(T.StringType())
def array_in(answer: pa.Array) -> pa.Array:
    return _found(find_array, answer)


@F.arrow_udf(T.StringType())
def checklist_in(answer: pa.Array, content: pa.Array) -> pa.Array:
    return _found(find_checklist, answer, content)
