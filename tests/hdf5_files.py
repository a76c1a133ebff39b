"""HDF5 files for tests, written from the format's description: an old one (symbol
tables, headers of the first version) and a new one (links and attributes in fractal
heaps, headers of the second version in several blocks)."""

import itertools
import struct
import zlib

import numpy as np

NOWHERE = (1 << 64) - 1


def q(*numbers, size=8):
    return b"".join(int(n).to_bytes(size, "little") for n in numbers)


def padded(b):
    return b + b"\0" * (-len(b) % 8)


def kind(x):
    if isinstance(x, str):
        return q(0x13, size=1) + q(0, size=3) + q(len(x) + 1, size=4)
    if isinstance(x, list):  # lists of references
        return q(0x19, size=1) + q(0, size=3) + q(16, size=4) + q(0x17, size=1) + q(0, size=3) + q(8, size=4)
    dtype = np.asarray(x).dtype
    size = dtype.itemsize
    if dtype.kind == "f":
        exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[size]
        return q(0x11, size=1) + bytes([0x20, size * 8 - 1, 0]) + q(size, size=4) + q(0, size * 8, size=2) + bytes([mantissa, exponent, 0, mantissa]) + q(bias, size=4)
    return q(0x10, size=1) + bytes([8 * (dtype.kind == "i"), 0, 0]) + q(size, size=4) + q(0, size * 8, size=2)


def space(shape, version):
    head = bytes([1, len(shape), 0, 0, 0, 0, 0, 0]) if version == 1 else bytes([2, len(shape), 0, int(bool(shape))])
    return head + q(*shape)


class File:
    def __init__(self, new):
        self.new, self.out = new, bytearray(512)

    def put(self, b):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += b
        return at

    def attribute(self, name, value):
        raw = value.encode() + b"\0" if isinstance(value, str) else b"".join(value) if isinstance(value, list) else np.asarray(value).tobytes()
        shape = () if isinstance(value, str) else (len(value),) if isinstance(value, list) else np.shape(value)
        parts = name.encode() + b"\0", kind(value), space(shape, 2 if self.new else 1)
        sizes = q(*map(len, parts), size=2)
        if self.new:
            return bytes([3, 0]) + sizes + b"\0" + b"".join(parts) + raw
        return bytes([1, 0]) + sizes + b"".join(map(padded, parts)) + raw

    def header(self, messages):
        """Two blocks, where there are several messages."""
        if not self.new:
            body = lambda ms: b"".join(q(k, len(padded(m)), size=2) + bytes(4) + padded(m) for k, m in ms)
            first, rest = messages[:2], messages[2:]
            if rest:
                more = body(rest)
                first = [*first, (16, q(self.put(more), len(more)))]
            block = body(first)
            return self.put(bytes([1, 0]) + q(len(first) + len(rest), size=2) + q(1, len(block), size=4) + bytes(4) + block)
        body = lambda ms: b"".join(bytes([k]) + q(len(m), size=2) + b"\0" + m for k, m in ms)
        first, rest = messages[:1], messages[1:]
        if rest:
            more = b"OCHK" + body(rest) + bytes(4)
            first = [*first, (16, q(self.put(more), len(more)))]
        block = body(first)
        return self.put(b"OHDR" + bytes([2, 0x20 | 1]) + bytes(16) + q(len(block), size=2) + block + bytes(4))

    def heap(self, objects, id_size):
        """A fractal heap: a root of two direct blocks of 512 bytes and one of 1,024."""
        head, frame = 5 + 8 + 4, 4
        blocks, ids, start = [bytearray(head)], [], 0
        sizes = [512, 512, 1024, 1024]
        for o in objects:
            if len(blocks[-1]) + len(o) + frame > sizes[len(blocks) - 1]:
                start += sizes[len(blocks) - 1]
                blocks.append(bytearray(head))
            ids.append(b"\0" + q(start + len(blocks[-1]), size=4) + q(len(o), size=2) + bytes(id_size - 7))
            blocks[-1] += o
        where = [self.put(b"FHDB" + bytes(13) + bytes(b[head:]) + bytes(sizes[k] - len(b))) for k, b in enumerate(blocks)]
        root = self.put(b"FHIB" + bytes(13) + q(*(where + [NOWHERE] * 4)[:4]) + bytes(4))
        fields = q(id_size, 0, size=2) + b"\0" + q(4096, size=4) + bytes(96) + q(2, size=2) + q(512, 65536) + q(32, 0, size=2) + q(root) + q(2, size=2)
        return self.put(b"FRHP\0" + fields + bytes(4)), ids

    def tree(self, records, size, kind_):
        """A B-tree of the second version, of depth one where a leaf is too small."""
        node = 512
        leaf = (node - 10) // size
        make = lambda name, rs: self.put(((name + bytes([0, kind_]) + b"".join(rs)).ljust(node, b"\0")))
        if len(records) <= 3:
            root, n, depth = make(b"BTLF", records), len(records), 0
        else:
            half = len(records) // 2
            parts = records[:half], records[half + 1 :]
            children = [make(b"BTLF", p) for p in parts]
            width = (leaf.bit_length() + 7) // 8
            pointers = b"".join(q(c) + q(len(p), size=width) for c, p in zip(children, parts, strict=True))
            root, n, depth = make(b"BTIN", [records[half], pointers]), 1, 1
        return self.put(b"BTHD" + bytes([0, kind_]) + q(node, size=4) + q(size, depth, size=2) + bytes([100, 40]) + q(root) + q(n, size=2) + q(len(records)) + bytes(4))

    def chunked(self, x, chunks, skip=()):
        """Shuffled, deflated chunks with checksums, under a B-tree of two levels."""
        entries = []
        for at in itertools.product(*(range(0, n, c) for n, c in zip(x.shape, chunks, strict=True))):
            if at in skip:
                continue
            block = np.zeros(chunks, x.dtype)
            part = x[tuple(slice(a, a + c) for a, c in zip(at, chunks, strict=True))]
            block[tuple(map(slice, part.shape))] = part
            raw = np.frombuffer(block.tobytes(), np.uint8).reshape(-1, x.itemsize).T.tobytes()
            plain = len(entries) == 1  # one chunk left without deflate, as its mask says
            raw = (raw if plain else zlib.compress(raw)) + bytes(4)
            entries.append((q(len(raw), 2 if plain else 0, size=4) + q(*at, 0), self.put(raw)))
        key = 8 + 8 * (x.ndim + 1)
        node = lambda level, es: self.put(b"TREE\1" + bytes([level]) + q(len(es), size=2) + q(NOWHERE, NOWHERE) + b"".join(k + q(a) for k, a in es) + bytes(key))
        half = len(entries) // 2
        return node(1, [(es[0][0], node(0, es)) for es in (entries[:half], entries[half:])])

    def dataset(self, x, attributes, chunks=None, skip=()):
        messages = [(1, space(x.shape, 2 if self.new else 1)), (3, kind(x))]
        if chunks:
            names = b"" if self.new else None
            filters = [(2, [x.itemsize]), (1, [4]), (3, [])]
            own = b"".join(q(k, size=2) + (b"" if self.new else q(0, size=2)) + q(0, len(v), size=2) + q(*v, size=4) + (bytes(4) if names is None and len(v) % 2 else b"") for k, v in filters)
            messages.append((11, bytes([2, 3]) + own if self.new else bytes([1, 3]) + bytes(6) + own))
            messages.append((8, bytes([3, 2, x.ndim + 1]) + q(self.chunked(x, chunks, skip)) + q(*chunks, x.itemsize, size=4)))
        else:
            raw = x.tobytes()
            messages.append((8, bytes([3, 1]) + q(self.put(raw), len(raw))))
        made = [self.attribute(k, v) for k, v in attributes.items()]
        if self.new and len(made) > 3:
            heap, ids = self.heap(made, 8)
            messages.append((21, bytes([0, 0]) + q(heap, self.tree([i + bytes(9) for i in ids], 17, 8))))
        else:
            messages += [(12, m) for m in made]
        return self.header(messages)

    def root(self, links):
        if self.new:
            made = [bytes([1, 0, len(n)]) + n.encode() + q(a) for n, a in links.items()]
            heap, ids = self.heap(made, 7)
            at = self.header([(2, bytes([0, 0]) + q(heap, self.tree([bytes(4) + i for i in ids], 11, 5)))])
            self.out[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + q(0, NOWHERE, len(self.out), at) + bytes(4)
            return
        names, offsets = b"\0" * 8, {}
        for n in sorted(links):
            offsets[n] = len(names)
            names += padded(n.encode() + b"\0")
        heap = self.put(b"HEAP" + bytes(4) + q(len(names), NOWHERE, self.put(names)))
        table = self.put(b"SNOD" + bytes([1, 0]) + q(len(links), size=2) + b"".join(q(offsets[n], links[n]) + bytes(24) for n in sorted(links)))
        tree = self.put(b"TREE" + bytes([0, 0]) + q(1, size=2) + q(NOWHERE, NOWHERE, 0, table, 0))
        at = self.header([(17, q(tree, heap))])
        entry = q(0, at) + bytes(24)
        self.out[: 24 + 32 + 40] = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + q(4, 16, size=2) + bytes(4) + q(0, NOWHERE, len(self.out), NOWHERE) + entry


def netcdf4(path, axes, name, values, chunks, new, skip=(), attributes=None):
    """A variable over its coordinates, as NetCDF-4 has them."""
    f = File(new)
    links = {d: f.dataset(np.asarray(x), {"CLASS": "DIMENSION_SCALE", "NAME": d} | ({"units": "days since 2000-01-01"} if d == "time" else {})) for d, x in axes.items()}
    objects = b"".join(q(k + 1, 1, size=2) + bytes(4) + q(8) + q(links[d]) for k, d in enumerate(axes))
    size = 16 + len(objects) + 16
    heap = f.put(b"GCOL\1\0\0\0" + q(size) + objects + bytes(16))
    scales = [q(1, size=4) + q(heap) + q(k + 1, size=4) for k in range(len(axes))]
    links[name] = f.dataset(values, {"DIMENSION_LIST": scales} | (attributes or {}), chunks, skip)
    f.root(links)
    path.write_bytes(bytes(f.out))
