"""Files in HDF5, as NetCDF-4 has them: their variables, attributes, dimensions and
chunks.

Read are superblocks of all versions, object headers of both, groups as symbol tables,
links in headers and links in fractal heaps, attributes likewise, and data that is
compact, contiguous or in chunks found by a B-tree of the first version, with shuffle,
deflate and checksum filters.  Other layouts and filters are refused by name.
Nothing is read but what is asked for: a variable's chunks are looked up in its
index, and each is read on its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: signature, messages of object headers, filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, TABLE, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1


@dataclass
class Kind:
    """How values are stored: a numpy type, or text, or lists or references."""

    size: int
    numpy: str | None = None
    text: bool = False
    list_of: Kind | None = None


@dataclass
class Chunk:
    """Where a chunk begins in the variable and in the file; address None: never written."""

    at: tuple[int, ...]
    address: int | None
    size: int
    skipped: int


@dataclass
class Dataset:
    address: int
    shape: tuple[int, ...] = ()
    kind: Kind = field(default_factory=lambda: Kind(0))
    layout: tuple = ()
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        return self.layout[2] if self.layout[0] == "chunks" else self.shape


class Bytes:
    """Little-endian numbers from a run of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def n(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")


class Hdf5:
    def __init__(self, f):
        self.f = f
        head = Bytes(self.at(0, 96))
        if head.take(8) != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head.n(1)
        if version < 2:
            head.at = 13
            self.offset, self.length = head.n(1), head.n(1)
            head.at = 24 if version == 0 else 28
            head.take(4 * self.offset + self.offset)  # base, free space, end, driver; the root's name
            root = head.n(self.offset)
        else:
            self.offset, self.length = head.n(1), head.n(1)
            head.take(1 + 3 * self.offset)
            root = head.n(self.offset)
        if (self.offset, self.length) != (8, 8):
            raise NotImplementedError("offsets and lengths of other than eight bytes")
        self.links = self._links(root)
        self.names = {address: name for name, address in self.links.items()}
        self._known: dict[str, Dataset] = {}

    def at(self, address: int, size: int) -> bytes:
        self.f.seek(address)
        return self.f.read(size)

    # object headers

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        """Kinds and contents of an object's messages."""
        head = Bytes(self.at(address, 64))
        out: list[tuple[int, bytes]] = []
        if head.data[:4] == b"OHDR":
            head.at = 5
            flags = head.n(1)
            head.take(16 * bool(flags & 32) + 4 * bool(flags & 16))
            size = head.n(1 << (flags & 3))
            todo = [(address + head.at, size)]
            while todo:
                where, size = todo.pop(0)
                block = Bytes(self.at(where, size))
                while block.at + 4 + 2 * bool(flags & 4) <= size:
                    kind, n = block.n(1), block.n(2)
                    shared = block.n(1) & 2
                    block.take(2 * bool(flags & 4))
                    self._take(out, todo, kind, block.take(n), shared, 4)
            return out
        count, size = int.from_bytes(head.data[2:4], "little"), int.from_bytes(head.data[8:12], "little")
        todo = [(address + 16, size)]
        while todo and count > 0:
            where, size = todo.pop(0)
            block = Bytes(self.at(where, size))
            while block.at + 8 <= size and count > 0:
                kind, n = block.n(2), block.n(2)
                shared = block.n(1) & 2
                block.take(3)
                self._take(out, todo, kind, block.take(n), shared, 0)
                count -= 1
        return out

    def _take(self, out: list, todo: list, kind: int, content: bytes, shared: int, frame: int) -> None:
        if kind == CONTINUED:  # blocks of the second version have a signature and a checksum
            b = Bytes(content)
            where, size = b.n(8), b.n(8)
            todo.append((where + frame, size - 2 * frame))
        elif shared:
            b = Bytes(content)
            version, _ = b.n(1), b.n(1)
            if version == 1:
                b.take(6)
            out += [m for m in self._messages(b.n(8)) if m[0] == kind][:1]
        else:
            out.append((kind, content))

    # groups

    def _links(self, group: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, content in self._messages(group):
            b = Bytes(content)
            if kind == TABLE:
                tree, heap = b.n(8), b.n(8)
                names = Bytes(self.at(heap, 32), 24).n(8)
                out |= self._symbols(tree, names)
            elif kind == LINK:
                name, address = self._link(content)
                out[name] = address
            elif kind == LINK_INFO:
                b.take(1)
                b.take(8 * (b.n(1) & 1))
                heap, tree = b.n(8), b.n(8)
                if heap != NOWHERE:
                    made = FractalHeap(self, heap)
                    out |= dict(self._link(made.get(r[4 : 4 + made.id_size])) for r in self._records(tree))
        return out

    def _symbols(self, node: int, names: int) -> dict[str, int]:
        head = Bytes(self.at(node, 24), 4)
        if head.data[:4] == b"SNOD":
            n = Bytes(head.data, 6).n(2)
            body, out = Bytes(self.at(node + 8, 40 * n)), {}
            for _ in range(n):
                name, address = body.n(8), body.n(8)
                body.take(24)
                out[self._until_zero(names + name)] = address
            return out
        head.take(2)
        n = head.n(2)
        body, out = Bytes(self.at(node + 24, 16 * n + 8)), {}
        for _ in range(n):
            body.take(8)
            out |= self._symbols(body.n(8), names)
        return out

    def _until_zero(self, address: int) -> str:
        out = b""
        while b"\0" not in out:
            out += self.at(address + len(out), 64)
        return out[: out.index(b"\0")].decode()

    @staticmethod
    def _link(content: bytes) -> tuple[str, int]:
        b = Bytes(content, 1)
        flags = b.n(1)
        kind = b.n(1) if flags & 8 else 0
        b.take(8 * bool(flags & 4) + bool(flags & 16))
        name = b.take(b.n(1 << (flags & 3))).decode()
        return name, b.n(8) if kind == 0 else NOWHERE

    def _records(self, tree: int) -> list[bytes]:
        """All records of a B-tree of the second version."""
        b = Bytes(self.at(tree, 38), 6)
        node, size, depth = b.n(4), b.n(2), b.n(2)
        b.take(2)
        root, n = b.n(8), b.n(2)
        leaf = (node - 10) // size
        # Most records in a subtree of each depth, and how wide its count is stored.
        most, width = [leaf], [0]
        for _ in range(depth):
            own = (leaf.bit_length() + 7) // 8
            fan = (node - 10 - (8 + own + width[-1])) // (size + 8 + own + width[-1])
            most.append(fan + (fan + 1) * most[-1])
            width.append((most[-1].bit_length() + 7) // 8)

        def below(address: int, n: int, depth: int) -> list[bytes]:
            b = Bytes(self.at(address, node), 6)
            out = [b.take(size) for _ in range(n)]
            if depth:
                for _ in range(n + 1):
                    child, count = b.n(8), b.n((leaf.bit_length() + 7) // 8)
                    b.take(width[depth - 1])
                    out += below(child, count, depth - 1)
            return out

        return [] if root == NOWHERE else below(root, n, depth)

    # datasets

    def dataset(self, name: str) -> Dataset:
        if name not in self._known:
            self._known[name] = self._dataset(self.links[name])
        return self._known[name]

    def _dataset(self, address: int) -> Dataset:
        out = Dataset(address)
        for kind, content in self._messages(address):
            if kind == DATASPACE:
                out.shape = self._shape(content)
            elif kind == DATATYPE:
                out.kind = self._kind(content)[0]
            elif kind == LAYOUT:
                out.layout = self._layout(content)
            elif kind == FILTERS:
                out.filters = self._filters(content)
            elif kind == ATTRIBUTE:
                self._attribute(content, out.attributes)
            elif kind == ATTRIBUTE_INFO:
                b = Bytes(content, 1)
                b.take(2 * (b.n(1) & 1))
                heap, tree = b.n(8), b.n(8)
                if heap != NOWHERE:
                    made = FractalHeap(self, heap)
                    for r in self._records(tree):
                        self._attribute(made.get(r[: made.id_size]), out.attributes)
        return out

    @staticmethod
    def _shape(content: bytes) -> tuple[int, ...]:
        if content[0] == 2 and content[3] == 2:
            return (0,)
        rank = content[1]
        b = Bytes(content, 8 if content[0] == 1 else 4)
        return tuple(b.n(8) for _ in range(rank))

    def _kind(self, content: bytes) -> tuple[Kind, int]:
        """A type and the bytes that describe it."""
        b = Bytes(content)
        version_class, bits = b.n(1), b.n(3)
        size = b.n(4)
        order = ">" if bits & 1 else "<"
        match version_class & 15:
            case 0:
                return Kind(size, f"{order}{'i' if bits & 8 else 'u'}{size}"), 12
            case 1:
                return Kind(size, f"{order}f{size}"), 20
            case 3:
                return Kind(size, text=True), 8
            case 7:
                return Kind(size, "<u8"), 8
            case 8:
                inner, used = self._kind(content[8:])
                return inner, 8 + used  # an enumeration reads as its numbers
            case 9:
                inner, used = self._kind(content[8:])
                return Kind(size, text=bits & 15 == 1, list_of=inner), 8 + used
        return Kind(size), 8

    def _layout(self, content: bytes) -> tuple:
        version, b = content[0], Bytes(content, 1)
        if version != 3:
            raise NotImplementedError(f"a data layout of version {version}")
        kind = b.n(1)
        if kind == 0:
            return "compact", b.take(b.n(2))
        if kind == 1:
            return "contiguous", b.n(8), b.n(8)
        rank = b.n(1)
        tree = b.n(8)
        sizes = tuple(b.n(4) for _ in range(rank))
        return "chunks", tree, sizes[:-1]

    @staticmethod
    def _filters(content: bytes) -> list[tuple[int, list[int]]]:
        version, n = content[0], content[1]
        b, out = Bytes(content, 8 if version == 1 else 2), []
        for _ in range(n):
            kind = b.n(2)
            named = b.n(2) if version == 1 or kind >= 256 else 0
            b.take(2)
            values = b.n(2)
            b.take(named + (-named % 8 if version == 1 else 0))
            own = [b.n(4) for _ in range(values)]
            b.take(4 * (version == 1 and values % 2))
            out.append((kind, own))
        return out

    def _attribute(self, content: bytes, out: dict) -> None:
        b = Bytes(content)
        version = b.n(1)
        b.take(1)
        name_size, kind_size, space_size = b.n(2), b.n(2), b.n(2)
        b.take(version == 3)
        pad = (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
        name = b.take(pad(name_size))[:name_size].split(b"\0")[0].decode()
        kind = self._kind(b.take(pad(kind_size)))[0]
        shape = self._shape(b.take(pad(space_size))) if space_size else ()
        count = int(np.prod(shape, dtype=np.int64))
        raw = b.take(count * kind.size)
        if kind.list_of is not None:
            parts = [self._listed(raw[k * 16 : k * 16 + 16], kind) for k in range(count)]
            out[name] = parts[0] if kind.text and count == 1 else parts
        elif kind.text:
            out[name] = raw.split(b"\0")[0].decode(errors="replace")
        elif kind.numpy:
            out[name] = np.frombuffer(raw, kind.numpy)

    def _listed(self, raw: bytes, kind: Kind) -> str | np.ndarray:
        """A value of variable length, from the global heap."""
        b = Bytes(raw)
        n, heap, index = b.n(4), b.n(8), b.n(4)
        size = n * kind.list_of.size
        data = b""
        if heap and n:
            whole = Bytes(self.at(heap, Bytes(self.at(heap, 16), 8).n(8)), 16)
            while whole.at + 16 <= len(whole.data):
                own, _, _, length = whole.n(2), whole.n(2), whole.n(4), whole.n(8)
                found = whole.take(length + -length % 8)
                if own == index:
                    data = found[:size]
                    break
                if own == 0:
                    break
        return data.decode(errors="replace") if kind.text else np.frombuffer(data, kind.list_of.numpy or "u1")

    # data

    def chunks(self, d: Dataset) -> list[Chunk]:
        """All chunks in order, written or not."""
        if d.layout[0] != "chunks":
            address = d.layout[1] if d.layout[0] == "contiguous" and d.layout[1] != NOWHERE else None
            return [Chunk((0,) * len(d.shape), address, int(np.prod(d.shape, dtype=np.int64)) * d.kind.size, 0)]
        found: dict[tuple[int, ...], Chunk] = {}
        todo = [d.layout[1]] if d.layout[1] != NOWHERE else []
        key = 8 + 8 * (len(d.shape) + 1)
        while todo:
            address = todo.pop()
            head = Bytes(self.at(address, 24), 5)
            level, n = head.n(1), head.n(2)
            b = Bytes(self.at(address + 24, n * (key + 8)))
            for _ in range(n):
                size, skipped = b.n(4), b.n(4)
                at = tuple(b.n(8) for _ in d.shape)
                b.take(8)
                child = b.n(8)
                if level:
                    todo.append(child)
                else:
                    found[at] = Chunk(at, child, size, skipped)
        steps = [range(0, n, c) for n, c in zip(d.shape, d.layout[2], strict=True)]
        grid = np.stack([g.ravel() for g in np.meshgrid(*steps, indexing="ij")], axis=1).tolist()
        return [found.get(at) or Chunk(at, None, 0, 0) for at in map(tuple, grid)]

    def read(self, d: Dataset, chunk: Chunk) -> np.ndarray | None:
        """A chunk's values inside the variable's bounds; None where it was never written."""
        if not d.kind.numpy:
            raise NotImplementedError("values that aren't numbers")
        if d.layout[0] == "compact":
            return np.frombuffer(d.layout[1], d.kind.numpy, int(np.prod(d.shape, dtype=np.int64))).reshape(d.shape)
        if chunk.address is None:
            return None
        raw = self.at(chunk.address, chunk.size)
        for k in reversed(range(len(d.filters))):
            kind, own = d.filters[k]
            if chunk.skipped >> k & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                size = own[0] if own else d.kind.size
                whole = len(raw) // size * size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                raise NotImplementedError(f"filter {kind}")
        x = np.frombuffer(raw, d.kind.numpy).reshape(d.chunk_shape)
        return x[tuple(slice(0, n - a) for n, a in zip(d.shape, chunk.at, strict=True))]

    def dimensions(self, name: str) -> list[str]:
        """Names of a variable's dimensions: those of the scales it refers to, or its own."""
        d = self.dataset(name)
        scales = d.attributes.get("DIMENSION_LIST")
        if scales:
            return [self.names.get(int(s[0]), f"dim{k}") if len(s) else f"dim{k}" for k, s in enumerate(scales)]
        return [name] if len(d.shape) == 1 and d.attributes.get("CLASS") == "DIMENSION_SCALE" else [f"dim{k}" for k in range(len(d.shape))]


class FractalHeap:
    """Small objects by their ids."""

    def __init__(self, file: Hdf5, address: int):
        self.file = file
        b = Bytes(file.at(address, 146), 5)
        self.id_size, filtered = b.n(2), b.n(2)
        b.take(1)
        limit = b.n(4)
        b.take(12 * 8)
        self.width, self.first, self.largest, bits = b.n(2), b.n(8), b.n(8), b.n(2)
        b.take(2)
        self.root, self.rows = b.n(8), b.n(2)
        if filtered:
            raise NotImplementedError("a filtered heap")
        self.offset_size = (bits + 7) // 8
        self.length_size = min((self.largest.bit_length() + 6) // 8, (limit.bit_length() + 7) // 8)
        self.head = 5 + 8 + self.offset_size  # of a block, up to its entries

    def _row_size(self, row: int) -> int:
        return self.first << max(row - 1, 0)

    def _place(self, offset: int) -> int:
        """Where in the file a place of the heap is.  Offsets count a block's own head."""
        block, rows, start = self.root, self.rows, 0
        while rows:
            at = start
            for row in range(rows):
                size = self._row_size(row)
                if offset < at + size * self.width:
                    column = (offset - at) // size
                    break
                at += size * self.width
            entry = self.file.at(block + self.head + 8 * (row * self.width + column), 8)
            block, start = int.from_bytes(entry, "little"), at + column * size
            rows = 0 if size <= self.largest else (size // self.first // self.width).bit_length()
        return block + offset - start

    def get(self, id_: bytes) -> bytes:
        kind = id_[0] >> 4 & 3
        if kind == 2:
            return id_[1 : 2 + (id_[0] & 15)]
        if kind == 1:
            raise NotImplementedError("huge objects of a heap")
        b = Bytes(id_, 1)
        offset, length = b.n(self.offset_size), b.n(self.length_size)
        return self.file.at(self._place(offset), length)
