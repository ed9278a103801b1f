"""Chat formatting at the level of tokens.

Every segment (an escaped text, or a role that has no id of its own) is encoded by itself, and reserved ids beyond the
vocabulary are spliced between the segments: one for each known role's header, one for the end of a turn. As text, a
turn reads `### User: <text></turn>` and a line end. In contents a backslash is put before each backslash and before
each control string (`### `, `</turn>`), so that no content can pass for a header; removing it restores the content
exactly. The loss mask covers the assistants' contents: +1 where such a segment starts and -1 where it ends, summed.

Rows keep one turn each, so a conversation may be of any length; reading back streams over the sorted turns.

Cases: null texts and roles count as empty; other roles than the known three are encoded between two reserved ids.
Turns of equal number are ordered by role and text. Repeated rows are turns like others. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import byte_symbols

CONTROLS = ("### ", "</turn>")
KNOWN = ("system", "user", "assistant")
END = "</turn>\n"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for x in CONTROLS:
        text = text.replace(x, "\\" + x)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Template:
    """A byte-level vocabulary and, beyond it, the reserved ids."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_symbols())}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.bytes = [b""] * (self.size + len(KNOWN) + 3)
        for token, i in spec["model"]["vocab"].items():
            if all(c in of for c in token):
                self.bytes[i] = bytes(of[c] for c in token)
        self.roles = {r: self.size + k for k, r in enumerate(KNOWN)}
        self.open, self.close, self.end = (self.size + len(KNOWN) + k for k in range(3))
        for r, i in self.roles.items():
            self.bytes[i] = f"### {r.capitalize()}: ".encode()
        self.bytes[self.open], self.bytes[self.close], self.bytes[self.end] = b"### ", b": ", END.encode()

    def assemble(self, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each (role, text)."""
        contents = self.tokenizer.encode_batch([escape(t) for _, t in turns], add_special_tokens=False)
        others = {r: self.tokenizer.encode(escape(r), add_special_tokens=False).ids for r in {r for r, _ in turns} - set(KNOWN)}
        out = []
        for (role, _), content in zip(turns, contents, strict=True):
            head = [self.roles[role]] if role in self.roles else [self.open, *others[role], self.close]
            ids = np.array([*head, *content.ids, self.end], dtype=np.int32)
            steps = np.zeros(len(ids) + 1, dtype=np.int8)
            if role == "assistant":
                steps[len(head)] += 1
                steps[len(head) + len(content.ids)] -= 1
            out.append((ids, np.cumsum(steps[:-1], dtype=np.int8)))
        return out

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids; the reserved ids alone tell where they lie."""
        if ids[-1] != self.end:
            raise ValueError("a turn doesn't end with its reserved id")
        if ids[0] == self.open:
            close = int(np.flatnonzero(ids == self.close)[0])
            return unescape(self.text(ids[1:close])), unescape(self.text(ids[close + 1 : -1]))
        role = next(r for r, i in self.roles.items() if i == ids[0])
        return role, unescape(self.text(ids[1:-1]))


_TEMPLATES: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _TEMPLATES:
        _TEMPLATES[path] = Template(path)
    return _TEMPLATES[path]


def format_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """turns: conv_id, turn, role, text. Per turn: conv_id, turn, role, ids, mask, and the text as a tie-breaker in order `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                made = form.assemble([(r or "", t or "") for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8()))], names=["conv_id", "turn", "role", "ids", "mask"])

    kinds = dict(turns.dtypes)
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, ids array<int>, mask array<tinyint>")


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation, from the ids and masks alone: the number of turns and the digests of turns and of the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(vocabulary)
        state: list | None = None
        pending: list[tuple[str, str]] = []

        def close() -> None:
            """Add the turns of equal number, in order of role and text."""
            for role, text, loss, chars in sorted(pending):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            pending.clear()

        def row() -> list:
            close()
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                conv, turn = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, turn]
                elif state[6] != turn:
                    close()
                    state[6] = turn
                ids, mask = batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()
                role, text = form.read(ids)
                pending.append((role, text, unescape(form.text(ids[mask > 0])), len(form.text(ids))))
            if rows:
                yield table(rows)
        if state is not None:
            yield table([row()])

    def table(rows: list[list]) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = dict(formatted.dtypes)["conv_id"]
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    dealt = formatted.select("conv_id", "turn", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_and_read(turns: DataFrame, vocabulary: str) -> DataFrame:
    return read_back(format_turns(turns, vocabulary), vocabulary)
