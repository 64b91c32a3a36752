"""Chat formatting by schema fingerprints.

A record is JSON of any of several layouts. The sorted set of its nested field paths is hashed; the hash
selects a declarative mapping from which the canonical turns are read. Turns are then written with a template
whose control strings are escaped inside texts, so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import map_rows

#: Template: user, assistant, any other role. A text lies between an opening and a closing string.
OPEN = {"user": "[INST] ", "assistant": "<s> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>"}
ROLE_OPEN, ROLE_END, ROLE_CLOSE = "[ROLE=", "] ", " [/ROLE]"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE=", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:[^\\\]]|\\.)*)\] ", re.S)


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets a backslash before its first character and one behind it."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "\\" + m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested paths, with [] for list items. The value at a path does not count, only whether it nests."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}") for k, v in value.items())) if value else {prefix + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """items: key of the list of messages, with the keys of role and text in each; or turns: (role, key or keys) read in order.
    Of several keys of a turn the texts that are there are joined by a blank line."""

    name: str
    items: str | None = None
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        if self.items is not None:
            own = [{f".{self.items}[].{self.role}", f".{self.items}[].{self.text}"}, {f".{self.items}[]"}]
        else:
            keys = [k for _, ks in self.turns for k in ks]
            own = [{f".{k}" for k in keys}]
        for k in self.optional:
            own += [{*o, f".{k}"} for o in own] + [o - {f".{k}"} for o in own]
        return sorted({fingerprint(o) for o in own if o})

    def needs(self) -> set[str]:
        """The paths without which a record is not of this layout."""
        if self.items is not None:
            return {f".{self.items}[].{self.role}", f".{self.items}[].{self.text}"}
        return {f".{k}" for _, ks in self.turns for k in ks if k not in self.optional}

    def read(self, record: dict) -> list[tuple[str, str]]:
        clean = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
        out = [("system", clean(record["system"]))] if "system" in self.optional and record.get("system") else []
        if self.items is not None:
            names = {"human": "user", "gpt": "assistant", "bot": "assistant"} if self.role == "from" else {}
            return out + [(names.get(r := clean(m.get(self.role)), r), clean(m.get(self.text))) for m in record[self.items] or () if isinstance(m, dict)]
        for role, keys in self.turns:
            texts = [clean(record.get(k)) for k in keys if record.get(k) or k not in self.optional]
            out.append((role, "\n\n".join(texts)))
        return out


MAPPINGS = (
    Mapping("messages", "messages", "role", "content", optional=("system",)),
    Mapping("messages_text", "messages", "role", "text", optional=("system",)),
    Mapping("conversations", "conversations", "from", "value", optional=("system",)),
    Mapping("conversation_roles", "conversation", "role", "content", optional=("system",)),
    Mapping("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input", "system")),
    Mapping("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)
REGISTRY = {f: m for m in reversed(MAPPINGS) for f in m.fingerprints()}
UNKNOWN, NO_RECORD = "no mapping describes this layout", "not a JSON object"


def canonical(payload: str | None) -> tuple[str | None, str, list[tuple[str, str]], str | None]:
    """(layout, fingerprint, turns, error).

    A fingerprint that no mapping has selects the first mapping whose paths the record has beside others (a name, a
    weight, tool calls): its turns are read and the other fields are left out. What has none of the layouts, or is no
    JSON object, has layout None, no turn and an error that says so.
    """
    try:
        record = json.loads(payload) if payload else None
    except ValueError:
        record = None
    paths = field_paths(record)
    key = fingerprint(paths)
    if not isinstance(record, dict):
        return None, key, [], NO_RECORD
    mapping = REGISTRY.get(key)
    if mapping is None:
        mapping = next((m for m in MAPPINGS if m.needs() <= paths), None)
    return (mapping.name, key, mapping.read(record), None) if mapping else (None, key, [], UNKNOWN)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (in it, in code points) of the assistant's texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        head = OPEN.get(role) or ROLE_OPEN + re.sub(r"([\\\]])", r"\\\1", role) + ROLE_END
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail := CLOSE.get(role, ROLE_CLOSE)]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted text; ValueError if it is none."""
    at, turns = 0, []
    while at < len(formatted):
        for role in (*OPEN, None):
            if formatted.startswith(OPEN.get(role, ROLE_OPEN), at):
                break
        else:
            raise ValueError(f"no turn at {at}")
        start = at + len(OPEN.get(role, ROLE_OPEN))
        if role is None:
            named = _ROLE.match(formatted, start)
            if named is None:
                raise ValueError(f"no role at {start}")
            name, start = unescape(named[1]), named.end()
        tail = CLOSE.get(role, ROLE_CLOSE)
        # a closing string can't stand inside a text: its control string is escaped there
        end = formatted.find(tail[1:], start) - 1
        if end < start:
            raise ValueError(f"the turn at {at} doesn't end")
        turns.append((role if role else name, unescape(formatted[start:end])))
        at = end + len(tail)
    return turns


def format_records(records: DataFrame, payload: str = "payload") -> DataFrame:
    """``row`` with layout, fingerprint, formatted, loss_spans and error (null where a mapping was found), from a column of JSON records."""

    def setup():
        def run(payloads):
            read = [canonical(p) for p in payloads]
            done = [render(r[2]) for r in read]
            return [[r[0] for r in read], [r[1] for r in read], [d[0] for d in done], [[{"start": a, "stop": b} for a, b in d[1]] for d in done], [r[3] for r in read]]

        return run

    return map_rows(records, [payload], setup, "layout string, fingerprint string, formatted string, loss_spans array<struct<start:long,stop:long>>, error string")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and one JSON record per conversation, its rows in order of turn (ties: role, then text; null first).

    The layout is the plainest that can hold the conversation: a prompt and its response, turns of a human and an
    assistant, or messages with any roles. A conversation is one record by definition, so its rows meet in one task;
    conversations are spread by id. Null roles and texts count as empty; repeated rows are turns of their own.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).withColumn("roles", F.transform("turns", lambda t: t["role"]))
    pair = F.struct(F.get("turns", F.lit(0))["content"].alias("prompt"), F.get("turns", F.lit(1))["content"].alias("response"))
    names = lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["content"].alias("value"))
    two = F.struct(F.transform("turns", names).alias("conversations"))
    any_ = F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
    plain = F.forall("roles", lambda r: r.isin("user", "assistant"))
    payload = F.when(F.col("roles") == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair)).when(plain, F.to_json(two)).otherwise(F.to_json(any_))
    return made.select("conv_id", payload.alias("payload"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``row`` with n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from formatted and loss_spans."""

    def setup():
        def one(text, spans):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            return len(turns), hashlib.sha256(whole.encode("utf-8", "replace")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text)

        return lambda texts, spans: list(zip(*map(one, texts, spans), strict=True))

    return map_rows(formatted, ["formatted", "loss_spans"], setup, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
