"""Chat formatting by incremental black-box rendering.

A template is any callable that turns a list of turns into text. The formatter renders every prefix of a conversation
and compares neighbours: what a prefix adds is the span of its last turn. If a longer rendering does not begin with the
shorter one, the template rewrote history: the conversation is marked, and spans that the change touches are unlocated
and leave the loss mask. Where the text of a turn stands inside its span is found by rendering the prefix with two
different probe texts: what both share before and after them surrounds the text.

Turns are ordered by turn, role and text (nulls first; null role and text are empty). Conversations pass through one
sorted stream that holds one of them at a time: every prefix is rendered from the first turn on, however long it is, which
is quadratic in a conversation. The text is returned in rows of `block_turns` turns that follow each other; where history
is rewritten the turns do not tile the text, and it stays in one row. Rows with a null conv_id are one conversation.
Repeated rows are repeated turns. Other columns are not read. An empty table gives an empty result.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
PROBES = "\ue000", "\ue001"
SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,located:boolean>>"
SCHEMA = f"conv_id long, block int, first_turn long, formatted string, rewrites boolean, spans {SPANS}"


class MarkedTurns:
    """`### role: text</turn>` per turn. A backslash splits every control string inside a role or text, and stands before
    every backslash, so that reading gives back the exact turns."""

    CONTROL = re.compile(r"\\|### |</turn>")
    SPLIT = {"\\": "\\\\", "### ": "#\\## ", "</turn>": "<\\/turn>"}
    TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)

    def escape(self, text):
        if "\\" not in text and "### " not in text and "</turn>" not in text:
            return text
        return self.CONTROL.sub(lambda m: self.SPLIT[m[0]], text)

    def unescape(self, text):
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def __call__(self, turns, first=0):
        return "".join(f"### {self.escape(role).replace(':', chr(92) + ':')}: {self.escape(text)}</turn>\n" for role, text in turns)

    def read(self, formatted):
        """(role, text) of every turn."""
        return [(self.unescape(m[1]), self.unescape(m[2])) for m in self.TURN.finditer(formatted)]


def common(a, b):
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def render(template, turns, first):
    """The whole rendering, the spans of its turns, and whether a longer prefix changed an earlier one."""
    spans, before, rewrites = [], template([], first), False
    for k, (role, _) in enumerate(turns):
        prefix, after = turns[:k], template(turns[: k + 1], first)
        same = common(before, after)
        if same < len(before):
            rewrites = True
            spans = [{**s, "located": s["located"] and s["end"] <= same} for s in spans]
        one, two = (template([*prefix, (role, p)], first) for p in PROBES)
        head, tail = common(one, two), common(one[::-1], two[::-1])
        start, end = head, len(after) - tail
        located = start >= same and end >= start and after[:head] == one[:head]
        spans.append({"role": role, "start": same, "end": len(after), "text_start": start, "text_end": end, "located": located})
        before = after
    return before, spans, rewrites


def rows_of(text, spans, rewrites, block_turns):
    """(block, first turn, text, rewrites, spans) of every row of a rendered conversation; their texts together are its text."""
    if rewrites:
        return [(0, 0, text, rewrites, spans)]
    firsts = range(0, len(spans), block_turns)
    cuts = [0, *(spans[k]["start"] for k in firsts[1:]), len(text)]
    places = "start", "end", "text_start", "text_end"
    return [
        (b, k, text[cuts[b] : cuts[b + 1]], rewrites, [{**s, **{c: s[c] - cuts[b] for c in places}} for s in spans[k : k + block_turns]])
        for b, k in enumerate(firsts)
    ]


def format_conversations(turns: DataFrame, template, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows (conv_id, block): the formatted text with its spans, counted from the row's begin. Blocks of a conversation follow each other in one partition."""

    def run(batches):
        held, state = [], {"conv": None}

        def close():
            text, spans, rewrites = render(template, held, 0)
            held.clear()
            return [(state["conv"], *row) for row in rows_of(text, spans, rewrites, block_turns)]

        def frame(rows):
            out = pd.DataFrame(rows, columns=["conv_id", "block", "first_turn", "formatted", "rewrites", "spans"])
            return out.assign(conv_id=out["conv_id"].astype("Int64"))

        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if held and conv != state["conv"]:
                    rows += close()
                state["conv"] = conv
                held.append((role, text))
            if rows:
                yield frame(rows)
        if held:
            yield frame(close())

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInPandas(run, SCHEMA)


def digests(formatted: DataFrame, template) -> DataFrame:
    """One row per conversation, read back from the formatted blocks in their order."""

    def run(batches):
        state = {"conv": None, "open": False}

        def begin(conv):
            state.update(conv=conv, open=True, n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), loss_chars=0, chars=0, rewrites=False)

        def close():
            return (state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"])

        def frame(rows):
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])
            return out.assign(conv_id=out["conv_id"].astype("Int64"))

        for batch in batches:
            rows = []
            for conv, text, rewrites, spans in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["rewrites"], batch["spans"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if not state["open"] or conv != state["conv"]:
                    if state["open"]:
                        rows.append(close())
                    begin(conv)
                for role, said in template.read(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["role"] == "assistant" and s["located"]:
                        part = template.unescape(text[s["text_start"] : s["text_end"]])
                        state["loss"].update(part.encode("utf-8", "surrogatepass"))
                        state["loss_chars"] += len(part)
                state["chars"] += len(text)
                state["rewrites"] = state["rewrites"] or bool(rewrites)
            if rows:
                yield frame(rows)
        if state["open"]:
            yield frame([close()])

    return formatted.select("conv_id", "formatted", "rewrites", "spans").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    )
