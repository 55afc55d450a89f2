"""Raw files read as streams, block by block: what is computed of a file while it passes.

A consumer takes blocks of bytes (``feed``) and is told the end (``close``); it keeps a bounded part of the file, whatever
its size. These are small helpers of the tasks that read files (see ``fingerprints`` and ``contracts``).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import zlib
from collections.abc import Sequence
from typing import BinaryIO
from xml.parsers import expat

BLOCK = 1 << 20
# Schemes that executors can open by themselves; files of other stores come as bytes, through Spark's reader.
LOCAL, REMOTE = ("", "file"), ("hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")


def opened(path: str) -> BinaryIO:
    """A file of a store, to be read from the start; it can seek."""
    scheme, _, rest = path.rpartition("://") if "://" in path else path.rpartition(":")
    if scheme in LOCAL:
        return open("/" + rest.lstrip("/") if scheme else path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return store.open_input_file(name)


class Digest:
    """SHA-256 of the bytes."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()

    def feed(self, block: bytes) -> None:
        self.hash.update(block)

    def close(self) -> None:
        pass

    def result(self) -> str:
        return self.hash.hexdigest()


class XmlDigest:
    """SHA-256 of the elements, attributes and texts of a document, without the text directly at the given paths (local
    names from the root on). Comments and the order of attributes don't count."""

    def __init__(self, ignored: Sequence[str]):
        self.ignored = {tuple(path.split("/")) for path in ignored}
        self.open: list[str] = []
        self.hash = hashlib.sha256()
        # the text since the last tag, which may come in pieces
        self.run: hashlib._Hash | None = None
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text
        self.parser.EntityDeclHandler = self.entity

    def say(self, *parts: str) -> None:
        for part in parts:
            data = part.encode()
            self.hash.update(len(data).to_bytes(8, "big") + data)

    def end_text(self) -> None:
        if self.run is not None:
            self.say("text", self.run.hexdigest())
            self.run = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self.end_text()
        self.open.append(name.rpartition("}")[2])
        self.say("start", name)
        for pair in sorted(attributes.items()):
            self.say(*pair)

    def text(self, data: str) -> None:
        if tuple(self.open) not in self.ignored:
            if self.run is None:
                self.run = hashlib.sha256()
            self.run.update(data.encode())

    def end(self, name: str) -> None:
        self.end_text()
        self.open.pop()
        self.say("end")

    def entity(self, *_: object) -> None:
        raise ValueError("XML with internal entities is refused")

    def feed(self, block: bytes) -> None:
        self.parser.Parse(block, False)

    def close(self) -> None:
        self.parser.Parse(b"", True)

    def result(self) -> str:
        return self.hash.hexdigest()


class Gunzip:
    """Hands the content of all members of a gzip on; each member's checksum and length are verified."""

    def __init__(self, *consumers):
        self.consumers = consumers
        self.member = zlib.decompressobj(wbits=31)
        self.inside, self.members = False, 0

    def feed(self, block: bytes) -> None:
        while block:
            if not self.inside:
                # zeros may stand between members and at the end
                block = block.lstrip(b"\0") if self.members else block
                if not block:
                    return
                self.member, self.inside = zlib.decompressobj(wbits=31), True
            out = self.member.decompress(block, BLOCK)
            block = self.member.unconsumed_tail
            for c in self.consumers:
                c.feed(out)
            if self.member.eof:
                block, self.inside = self.member.unused_data, False
                self.members += 1

    def close(self) -> None:
        # what is left of the last block's output
        while self.inside and not self.member.eof:
            out = self.member.decompress(self.member.unconsumed_tail, BLOCK)
            if not out and not self.member.eof:
                raise EOFError("the gzip ends within a member")
            for c in self.consumers:
                c.feed(out)
        if not self.members and not self.inside:
            raise EOFError("the gzip has no member")
        for c in self.consumers:
            c.close()


class Start:
    """The first characters after white space and a byte order mark: is it a web page?"""

    _PAGE = re.compile(rb"<!doctype html|<html", re.I)

    def __init__(self) -> None:
        self.start = b""

    def feed(self, block: bytes) -> None:
        if len(self.start) < 16:
            start = (self.start + block[: BLOCK]).lstrip()
            self.start = start.removeprefix(codecs.BOM_UTF8).lstrip()[:16]

    def close(self) -> None:
        pass

    def is_page(self) -> bool:
        return bool(self._PAGE.match(self.start))


class Ends:
    """Size, and the first and last four bytes."""

    def __init__(self) -> None:
        self.size, self.first, self.last = 0, b"", b""

    def feed(self, block: bytes) -> None:
        self.size += len(block)
        self.first = (self.first + block[:4])[:4]
        self.last = (self.last + block[-4:])[-4:]

    def close(self) -> None:
        pass


class Header:
    """Everything before the first line break."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.done = False

    def feed(self, block: bytes) -> None:
        if not self.done:
            line, end, _ = block.partition(b"\n")
            self.parts.append(line)
            self.done = bool(end)

    def close(self) -> None:
        pass

    def names(self, delimiter: str) -> tuple[str, list[str]]:
        header = b"".join(self.parts).decode("utf-8-sig", "replace").rstrip("\r")
        return header, [re.sub('^"|"$', "", c.strip()) for c in header.split(delimiter)]


class Root:
    """Name of the root element. A parser reads what stands before it, however long; then it is left alone."""

    def __init__(self) -> None:
        self.root: str | None = None
        self.entities = self.broken = False
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.StartElementHandler = self.start
        self.parser.EntityDeclHandler = self.entity

    def start(self, name: str, _: dict[str, str]) -> None:
        if self.root is None:
            self.root = name.rpartition("}")[2]

    def entity(self, *_: object) -> None:
        self.entities = True
        raise ValueError("internal entity")

    def _parse(self, block: bytes, final: bool) -> None:
        if self.root is None and not self.entities and not self.broken:
            try:
                self.parser.Parse(block, final)
            except (expat.ExpatError, ValueError, LookupError):
                self.broken = not self.entities and self.root is None

    def feed(self, block: bytes) -> None:
        # small pieces: little is parsed beyond the root
        for i in range(0, len(block), 1 << 14):
            if self.root is not None or self.entities or self.broken:
                return
            self._parse(block[i : i + (1 << 14)], False)

    def close(self) -> None:
        self._parse(b"", True)


class Json:
    """Is it one JSON value, and which keys does its object have? Read token by token."""

    _TEXT = r'[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*'
    _NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
    _TOKEN = re.compile(rf'[ \t\r\n]*(?:(?P<mark>[{{}}\[\],:])|"(?P<text>{_TEXT})"|(?P<number>{_NUMBER})|(?P<word>true|false|null))')
    _SPACE = re.compile(r"[ \t\r\n]*")
    _NUMERIC = re.compile(r"[-+.eE0-9]*")

    def __init__(self, wanted: str | None = None):
        self.wanted, self.found, self.valid = wanted, False, True
        self.decoder = codecs.getincrementaldecoder("utf-8-sig")()
        self.rest, self.patience = "", 0
        self.open: list[str] = []
        # what may come next: a value, a key, ":", "," or an end, nothing
        self.next = "value"

    def feed(self, block: bytes) -> None:
        if self.valid:
            try:
                self.rest += self.decoder.decode(block)
            except UnicodeDecodeError:
                self.valid = False
                return
            # a token longer than the blocks is looked at again when twice as much is there
            if len(self.rest) >= self.patience:
                self._read(False)

    def _read(self, final: bool) -> None:
        at, text = 0, self.rest
        while self.valid:
            m = self._TOKEN.match(text, at)
            # a number may go on in the next block
            if m is None or (m["number"] and not final and self._NUMERIC.match(text, m.end()).end() == len(text)):
                break
            at = m.end()
            self.valid = self._take(m)
        self.rest = text[self._SPACE.match(text, at).end() :]
        self.patience = 2 * len(self.rest)
        if self.rest and self.valid and not final:
            # the beginning of a token, or nothing that can become one
            self.valid = self.rest[0] == '"' or len(self.rest) < 8 or self.rest[0] in "-0123456789"

    def _take(self, m: re.Match) -> bool:
        mark, inside = m["mark"], self.open[-1] if self.open else ""
        if mark in ("}", "]"):
            opener = "{" if mark == "}" else "["
            if inside != opener or self.next not in ("comma", "first"):
                return False
            self.open.pop()
            self.next = "comma" if self.open else "nothing"
        elif mark == ",":
            if self.next != "comma":
                return False
            self.next = "key" if inside == "{" else "value"
        elif mark == ":":
            if self.next != "colon":
                return False
            self.next = "value"
        elif self.next == "key" or (self.next == "first" and inside == "{"):
            if m["text"] is None:
                return False
            if len(self.open) == 1 and self.wanted is not None and not self.found:
                self.found = json.loads(f'"{m["text"]}"') == self.wanted
            self.next = "colon"
        elif self.next in ("value", "first"):
            if mark:
                self.open.append(mark)
                self.next = "first"
            else:
                self.next = "comma" if self.open else "nothing"
        else:
            return False
        return True

    def close(self) -> None:
        if self.valid:
            try:
                self.rest += self.decoder.decode(b"", True)
            except UnicodeDecodeError:
                self.valid = False
                return
            self._read(True)
            self.valid = self.valid and not self.rest and self.next == "nothing"


def through(stream: BinaryIO, consumers: Sequence) -> list[Exception | None]:
    """Feed a stream to all consumers; one that fails gets nothing more, its error is returned in its place."""
    errors: list[Exception | None] = [None] * len(consumers)

    def each(call) -> None:
        for i, c in enumerate(consumers):
            if errors[i] is None:
                try:
                    call(c)
                except (expat.ExpatError, ValueError, EOFError, zlib.error) as exc:
                    errors[i] = exc

    while block := stream.read(BLOCK):
        each(lambda c: c.feed(block))
        if all(e is not None for e in errors):
            break
    each(lambda c: c.close())
    return errors
