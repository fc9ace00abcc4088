"""The few Arrow helpers for what built-in functions cannot do."""

from __future__ import annotations

import base64
import contextlib
import email
import hashlib
import heapq
import json
import re
import zlib
from email import policy
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text is hidden.
HIDDEN = ("script", "style")
#: Messages of a batch that are Python values at once.
MESSAGES = 200


class _Page(HTMLParser):
    """Collects the text of a page outside of hidden elements, whose content the parser takes raw and so knows itself."""

    def __init__(self):
        super().__init__()
        self.seen: list[str] = []

    def handle_data(self, data: str) -> None:
        if self.cdata_elem not in HIDDEN:
            self.seen.append(data)


def single_spaced(text: str) -> str:
    """``text`` with one blank for each run of white space and none at its ends."""
    return " ".join(text.split())


def html_text(html: str | None) -> str:
    """What a reader of the page sees, with single blanks; every tag parts words."""
    page = _Page()
    page.feed(html or "")
    return single_spaced(" ".join(page.seen))


def decoded(payload: bytes, charset: str | None) -> str:
    """A payload in its charset; in UTF-8 if that is undeclared or unknown."""
    for name in filter(None, (charset, "utf-8")):
        with contextlib.suppress(LookupError):
            return str(payload, name, "replace")
    return ""


#: How the text of a part is read, by its subtype; the first one that a message has counts.
READ = {"plain": single_spaced, "html": html_text}


def mail_body(raw: bytes | None) -> str:
    """The text of a message: its plain part, else its visible html."""
    message = email.message_from_bytes(bytes(raw or b""), policy=policy.default)
    for subtype in READ:
        if (part := message.get_body((subtype,))) is not None:
            payload = part.get_payload(decode=True) or b""
            return READ[subtype](decoded(payload, part.get_content_charset()))
    return ""


def mail_bodies(raw: pa.Array) -> pa.Array:
    """:func:`mail_body` of each message of a batch."""
    parts = (raw.slice(k, MESSAGES) for k in range(0, max(1, len(raw)), MESSAGES))
    return pa.concat_arrays([pa.array(map(mail_body, part.to_pylist()), pa.string()) for part in parts])


def visible_text(html: Column) -> Column:
    """Text of an HTML page."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return run(html)


def mail_text(raw: Column) -> Column:
    """Text of a binary message; of a batch, some hundred messages at a time are Python values."""
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return mail_bodies(batch)

    return run(raw)


def exact_casefold(s: Column) -> Column:
    """Full Unicode case folding."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.casefold()

    return run(s)


def leaves_of(value) -> list[str]:
    """String leaves of nested JSON, depth first; an explicit stack, so depth is no limit."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def json_leaves(s: Column) -> Column:
    """``array<string>`` of the string leaves of a JSON text; text that is no JSON is its own leaf."""
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            try:
                return leaves_of(json.loads(t))
            except ValueError:
                return [t]

        return x.map(one)

    return run(s)


REGION = "struct<key:int,left:double,top:double,right:double,bottom:double>"


def regions(tree: str | None) -> list[dict] | None:
    """Visible leaves of a UI tree with bounds inside the screen, the first of equal bounds; null for a malformed tree."""
    try:
        root = json.loads(tree)["activity"]["root"]
        width, height = root["bounds"][2], root["bounds"][3]
        found, taken, stack, number = [], set(), [root], 0
        while stack:
            node = stack.pop()
            if not isinstance(node, dict):
                return None
            key, number = number, number + 1
            below = node.get("children") or []
            stack.extend(reversed(below))
            box = tuple(node.get("bounds") or ())
            if below or len(box) != 4 or node.get("visibility", "visible") != "visible" or box in taken:
                continue
            left, top, right, bottom = box
            if 0 <= left < right <= width and 0 <= top < bottom <= height:
                taken.add(box)
                found.append({"key": key, "left": round(left / width, 4), "top": round(top / height, 4), "right": round(right / width, 4), "bottom": round(bottom / height, 4)})
        return found
    except (ValueError, KeyError, TypeError, IndexError):
        return None


def region_candidates(tree: Column) -> Column:
    """``array<struct<key,left,top,right,bottom>>`` of a UI tree as JSON."""
    @F.pandas_udf(f"array<{REGION}>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(regions)

    return run(tree)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The client of a path's store, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def make_folder(path: str) -> None:
    """Makes a folder, and those above it, where it is not there yet."""
    store, at = store_of(path)
    store.create_dir(at, recursive=True)


def write_file(path: str, content: bytes) -> None:
    """Writes a file through the client of its store."""
    store, at = store_of(path)
    with store.open_output_stream(at) as f:
        f.write(content)


def file_digest(path: str) -> tuple[int | None, str | None]:
    """Bytes and SHA-256 of a file too large for one row, read in chunks through the client of its store; nulls if there is no such file."""
    store, at = store_of(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None, None
    h, n = hashlib.sha256(), 0
    with store.open_input_stream(at, compression=None) as f:
        while chunk := f.read(1 << 22):
            h.update(chunk)
            n += len(chunk)
    return n, h.hexdigest()


# Fixed value: how a byte-level vocabulary's own pre-tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(SPLIT)
_LONG = 2000


class Ranks:
    """Counts tokens of a byte-level vocabulary of ranks. A word is merged once and its number of tokens remembered."""

    most = 500_000

    def __init__(self, raw: bytes):
        pairs = (line.split() for line in raw.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self._known: dict[str, int] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """The word's tokens: of all neighbouring parts that make a token, those of the least rank are joined first, from the left."""
        parts: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[word[k : k + 2]], k, 2) for k in range(len(parts) - 1) if word[k : k + 2] in self.ranks]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                both = parts[k] + parts[after[k]]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], k, len(both)))

        while heap:
            _, k, size = heapq.heappop(heap)
            right = after[k] if parts[k] is not None else len(parts)
            if right >= len(parts) or len(parts[k]) + len(parts[right]) != size:
                continue  # one of both has been joined with another since
            parts[k], parts[right], after[k] = parts[k] + parts[right], None, after[right]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [p for p in parts if p is not None]

    def count(self, text: str | None) -> int:
        """How many tokens a text has; none if it is null."""
        if not text:
            return 0
        if len(self._known) > self.most:
            self._known.clear()
        n, known = 0, self._known
        for w in _WORDS.findall(text):
            c = known.get(w)
            if c is None:
                c = len(self.merged(w.encode()))
                if len(w) < _LONG:
                    known[w] = c
            n += c
        return n


_RANKS: dict[int, Ranks] = {}


def token_counts(text: Column, vocabulary: Broadcast) -> Column:
    """How many tokens of a vocabulary each text has; ``vocabulary``: the bytes of a file of ranks, broadcast."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        key = zlib.crc32(vocabulary.value)
        if key not in _RANKS:
            _RANKS.clear()
            _RANKS[key] = Ranks(vocabulary.value)
        return s.map(_RANKS[key].count).astype("int32")

    return run(text)
