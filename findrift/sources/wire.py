"""The wire form of a log: its schema, and a strict bounded JSON reader.

``from_json`` keeps the last of two equal members and turns wrong types into nulls; here both fail the
file.  Members that the engine doesn't read are skipped, but still count towards depth and string limits.
"""

from __future__ import annotations

import json
import re

from findrift.config import Limits

ARTIFACT = {"uri": str, "uriBaseId": str, "index": int}
MESSAGE = {"text": str, "markdown": str}
REGION = {
    **dict.fromkeys(("startLine", "startColumn", "endLine", "endColumn", "charOffset", "charLength", "byteOffset", "byteLength"), int),
    "snippet": {"text": str, "markdown": str},
}
#: Members of which only the presence matters; kept as raw JSON.
RAW = object()
LOCATION = {"physicalLocation": {"artifactLocation": ARTIFACT, "region": REGION}, "message": MESSAGE, "logicalLocations": RAW}
RULE = {"id": str, "properties": {"tags": [str]}}
COMPONENT = {"name": str, "version": str, "semanticVersion": str, "rules": [RULE]}
RESULT = {
    "ruleId": str, "ruleIndex": int, "level": str, "kind": str, "baselineState": str, "message": MESSAGE,
    "fingerprints": {"*": str}, "partialFingerprints": {"*": str}, "locations": [LOCATION], "relatedLocations": [LOCATION],
    "codeFlows": [{"threadFlows": [{"locations": [{"location": LOCATION}]}]}],
    "logicalLocations": RAW, "stacks": RAW, "suppressions": RAW, "attachments": RAW,
}
RUN = {
    "tool": {"driver": COMPONENT, "extensions": [COMPONENT]}, "automationDetails": {"id": str}, "originalUriBaseIds": {"*": ARTIFACT},
    "artifacts": [{"location": ARTIFACT}], "invocations": [{"workingDirectory": ARTIFACT}], "graphs": RAW, "results": [RESULT],
}
LOG = {"version": str, "runs": [RUN]}


def ddl(shape) -> str:
    """The Spark type of a wire shape."""
    if shape is str or shape is RAW:
        return "string"
    if shape is int:
        return "int"
    if isinstance(shape, list):
        return f"array<{ddl(shape[0])}>"
    if "*" in shape:
        return f"map<string,{ddl(shape['*'])}>"
    return "struct<" + ",".join(f"{k}:{ddl(v)}" for k, v in shape.items()) + ">"


class Refused(ValueError):
    """A log that can't be read: the diagnostic's code, stage and message."""

    def __init__(self, code: str, stage: str, message: str) -> None:
        super().__init__(message)
        self.code, self.stage, self.message = code, stage, message


_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)


def _bounds(text: str, limits: Limits) -> None:
    """Depth and string lengths of the whole text, skipped members included."""
    depth = 0
    for m in _MARK.finditer(text):
        c = text[m.start()]
        if c == '"':
            if m.end() - m.start() - 2 > limits.maximum_string_characters:
                raw = m[0]
                if len(json.loads(raw).encode("utf-16-le", "surrogatepass")) // 2 > limits.maximum_string_characters:
                    raise Refused("SECURITY0103", "security", "A string exceeds the configured limit.")
        elif c in "[{":
            depth += 1
            if depth > limits.maximum_json_depth:
                raise Refused("SECURITY0100", "security", "The log is nested too deeply.")
        else:
            depth -= 1


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("PARSE0100", "parse", "A member is given twice.")
    return out


def _conform(value, shape):
    """The value's part that the shape names; a wrong type refuses the log."""
    if value is None:
        return None
    if shape is RAW:
        return json.dumps(value)
    if shape is str or shape is int:
        if not isinstance(value, shape) or isinstance(value, bool) or (shape is int and not -(1 << 31) <= value < 1 << 31):
            raise Refused("PARSE0100", "parse", "A member has a wrong type.")
        return value
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise Refused("PARSE0100", "parse", "A member has a wrong type.")
        return [_conform(x, shape[0]) for x in value]
    if not isinstance(value, dict):
        raise Refused("PARSE0100", "parse", "A member has a wrong type.")
    if "*" in shape:
        return {k: _conform(v, shape["*"]) for k, v in value.items()}
    return {k: _conform(value[k], s) for k, s in shape.items() if k in value}


def _constant(name: str):
    raise Refused("PARSE0100", "parse", "The log is no valid JSON.")


def read_log(raw: bytes, limits: Limits = Limits()) -> dict:  # noqa: B008
    """A log's known members; ``Refused`` where it is no valid JSON or breaks a limit."""
    if len(raw) > limits.maximum_input_bytes:
        raise Refused("SECURITY0100", "security", "The log exceeds the input limit.")
    try:
        text = raw.decode("utf-8-sig")
        _bounds(text, limits)
        value = json.loads(text, object_pairs_hook=_object, parse_constant=_constant)
    except Refused:
        raise
    except (ValueError, RecursionError):
        raise Refused("PARSE0100", "parse", "The log is no valid JSON.") from None
    if not isinstance(value, dict):
        raise Refused("SCHEMA0100", "schema", "The log must be an object.")
    log = _conform(value, LOG)
    _flow_budget(log, limits)
    return log


def _flow_budget(log: dict, limits: Limits) -> None:
    """Thread flows and their locations over all code flows of a result, each within one limit."""
    for run in log.get("runs") or []:
        for result in (run or {}).get("results") or []:
            flows = [t for f in (result or {}).get("codeFlows") or [] for t in (f or {}).get("threadFlows") or []]
            places = sum(len((t or {}).get("locations") or []) for t in flows)
            if max(len(flows), places) > limits.maximum_thread_flow_locations_per_result:
                raise Refused("SECURITY0102", "security", "A result has too many thread flows or locations.")
