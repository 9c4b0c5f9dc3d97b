"""Exact encoding and decoding with a merge-type sentencepiece model, by backtracking.

A text is cut where no merge can cross: before a run of spaces and around line ends, which only byte pieces spell. A
part is covered from the left by the longest pieces that an Aho-Corasick automaton finds. A piece may follow another only if
merging their joined characters gives the two back; else the next shorter prefix is tried, and where none fits,
the last piece is taken back and its end marked in a bitfield, so that no position fails twice. Characters without
a piece become their bytes' pieces. Decoding looks at the ids only.

Rows: null counts as empty, which has no ids and decodes to the empty text. A text of any length is encoded whole, a line without spaces as one
part. Repeated rows and ids each come back, and an empty table gives an empty result. The model file has to be at the same path
on every executor. Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.llm.common import Memo, held, named

SPACE = "▁"
#: Bytes of what a worker remembers of parts after a space and of parts at line starts, and how many pairs of pieces it knows to fit or not.
SPACED, BARE, PAIRS = 48 << 20, 8 << 20, 250_000
#: Parts that are decoded at once.
BLOCK = 20_000

# U+FFFD for each single byte that starts no character
codecs.register_error("loomgraph-bytes", lambda e: ("\ufffd", e.start + 1))


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        # by decimal id: what a piece shows; bytes beyond ASCII as lone surrogates until all bytes of a character are there
        self.shown = {str(i): p.replace(SPACE, " ") for i, p in self.piece.items()} | {str(i): chr(b if b < 128 else 0xDC00 + b) for b, i in self.byte.items()}
        if len(self.byte) != 256:
            raise ValueError("the model must have a piece for every byte")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("the model has pieces that cross spaces or line ends, or characters without a piece")
        if model.encode("a  b ") != model.encode("a  b ".replace(" ", SPACE)):
            raise ValueError("the model must keep spaces as they are")
        self.known = {p for p in self.id if len(p) == 1}
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        # by id
        self.length = [len(self.piece.get(i, "")) for i in range(n)]
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in (self.piece.get(i, "") for i in range(n))]
        self.name = list(map(str, range(n)))
        #: By piece, or None at the start, which pieces may follow it; for the pairs that were asked for.
        self.after: dict[int | None, dict[int, bool]] = {}
        self.pairs = 0
        self.spaced = Memo(lambda w: self._ids(" " + w), SPACED)
        self.bare = Memo(self._ids, BARE)

    def merged(self, chars: str) -> list[str]:
        """The model's own procedure: again and again the best-scored adjacent pair, the leftmost of equals."""
        parts = list(chars)
        while True:
            best = None
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, last: int | None, piece: int) -> bool:
        """Whether merging the characters of both, or of the first piece alone, gives them back."""
        parts = [self.piece[i] for i in ([piece] if last is None else [last, piece])]
        if self.pairs >= PAIRS:
            self.after.clear()
            self.pairs = 0
        self.pairs += 1
        out = self.after.setdefault(last, {})[piece] = self.merged("".join(parts)) == parts
        return out

    def _covered(self, chars: str) -> list[int]:
        """Ids of a run of characters that all have pieces."""
        n = len(chars)
        longest: list[int | None] = [None] * (n + 1)
        for end, (i, size) in self.find.iter(chars):
            longest[end - size + 1] = i  # ends rise, so the last found for a start is the longest
        after, length, shorter, none = self.after, self.length, self.shorter, {}
        out: list[int] = []
        failed: bytearray | None = None
        at, piece, last = 0, longest[0], None
        while at < n:
            known = after.get(last, none)
            while piece is not None:
                end = at + length[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = known.get(piece)
                    if fits or (fits is None and self._fits(last, piece)):
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at, last, piece = end, piece, longest[end]
                continue
            if failed is None:
                failed = bytearray(n // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            piece = out.pop()
            at -= length[piece]
            last = out[-1] if out else None
        return out

    def _ids(self, chars: str) -> str:
        """Ids of a part, joined by commas."""
        out: list[int] = []
        chars = chars.replace(" ", SPACE)
        if chars and self.known.issuperset(chars):
            return ",".join(map(self.name.__getitem__, self._covered(chars)))
        run = ""
        for c in chars:
            if c in self.id:
                run += c
                continue
            if run:
                out += self._covered(run)
                run = ""
            out += [self.byte[b] for b in c.encode()]
        if run:
            out += self._covered(run)
        return ",".join(map(str, out))

    def parts(self, text: str) -> list[str]:
        """Ids of a text, as comma-joined strings of its parts; a space is put before the text."""
        if not text:
            return []
        out: list[str] = []
        spaced, bare = self.spaced, self.bare
        end = bare["\n"]
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            parts = line.split(" ")
            if k:
                out.append(end)
                if parts[0]:
                    out.append(bare[parts[0]])
                del parts[0]
            if "" not in parts:
                out += spaced.many(parts)
                continue
            spaces = 0
            for p in parts[:-1]:
                if p:
                    out.append(spaced[" " * spaces + p])
                    spaces = 0
                else:
                    spaces += 1
            out.append(spaced[" " * spaces + parts[-1]])
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part.split(",")]

    def decoded(self, parts: list[str]) -> str:
        """The text of comma-joined ids, without the space that encoding put first; a block of parts at a time."""
        shown, out = self.shown, []
        for k in range(0, len(parts), BLOCK):
            out.append("".join(map(shown.__getitem__, ",".join(parts[k : k + BLOCK]).split(","))))
        text = "".join(out)
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:  # some characters are in bytes
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "loomgraph-bytes")
        return text[1:] if text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        return self.decoded(list(map(str, ids)))


def codec(path: str) -> PieceCodec:
    return held(("codec", path), lambda: PieceCodec(path))


def _each(path: str, full: bool):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for f in frames:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if full else {})
            for text in f["text"]:
                parts = own.parts(text) if text else []
                ids, decoded = ",".join(parts), own.decoded(parts)
                out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    out["ids"].append([int(i) for i in ids.split(",")] if ids else [])
                    out["decoded"].append(decoded)
            yield pd.DataFrame({"id": f["id"], **out})

    return rows


def piece_codes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """id, n_tokens, the digests of the comma-joined ids and of the decoded text, and with ``full`` both themselves."""
    rows = named(docs, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return rows.mapInPandas(_each(model, full), schema)
