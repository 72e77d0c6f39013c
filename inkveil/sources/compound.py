"""Compound files (the container of the older office formats): streams by path, read whole, written in place, or built anew.

From the published description of the format: a header, sectors chained by an allocation table, a directory whose entries form a
tree, and small streams in sectors of their own within the root's stream. Chains and trees are followed no further than they can
be long, so a broken or hostile file ends with an error and not in a loop."""

from __future__ import annotations

import struct

import numpy as np

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
STORAGE, STREAM, ROOT = 1, 2, 5
#: Streams under this many bytes lie in small sectors.
CUTOFF = 4096


class Broken(ValueError):
    """A file that isn't what it should be, or is encrypted."""


class Compound:
    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or not data.startswith(SIGNATURE):
            raise Broken("no compound file")
        shift, small = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small != 6:
            raise Broken("unknown sector size")
        self.data, self.size, self.small = data, 1 << shift, 1 << small
        n_fat, first_dir, _, _, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        tables = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_difat):
            if first_difat >= DIFAT:
                break
            more = self._numbers([first_difat])
            tables += more[:-1].tolist()
            first_difat = int(more[-1])
        self.fat = self._numbers([t for t in tables[:n_fat] if t < DIFAT])
        self.entries = self._directory(first_dir)
        self.mini = self._numbers(self._chain(first_mini, self.fat)) if first_mini < DIFAT else np.empty(0, np.uint32)
        self.root_sectors = self._chain(self.entries[0][2], self.fat) if self.entries[0][2] < DIFAT else []
        self.streams = dict(self._walk())

    def _sector(self, k: int) -> int:
        at = (k + 1) * self.size
        if at >= len(self.data):
            raise Broken("a sector beyond the end")
        return at

    def _numbers(self, sectors: list[int]) -> np.ndarray:
        raw = b"".join(self.data[(a := self._sector(k)) : a + self.size].ljust(self.size, b"\xff") for k in sectors)
        return np.frombuffer(raw, "<u4")

    @staticmethod
    def _chain(first: int, table: np.ndarray) -> list[int]:
        out = []
        while first < DIFAT:
            if first >= len(table) or len(out) > len(table):
                raise Broken("a chain leads nowhere")
            out.append(int(first))
            first = int(table[first])
        return out

    def _directory(self, first: int) -> list[tuple]:
        """(name, kind, start, size, left, right, child) of each entry."""
        raw = b"".join(self.data[(a := self._sector(k)) : a + self.size] for k in self._chain(first, self.fat))
        out = []
        for at in range(0, len(raw) - 127, 128):
            n, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<III", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            size = size & 0xFFFFFFFF if self.size == 512 else size
            out.append((raw[at : at + max(min(n, 64) - 2, 0)].decode("utf-16le", "replace"), kind, start, size, left, right, child))
        if not out or out[0][1] != ROOT:
            raise Broken("no root entry")
        return out

    def _walk(self):
        todo, seen = [(self.entries[0][6], "")], set()
        while todo:
            k, folder = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, _, _, left, right, child = self.entries[k]
            todo += [(left, folder), (right, folder)]
            if kind == STORAGE:
                todo.append((child, f"{folder}{name}/"))
            elif kind == STREAM:
                yield folder + name, k

    def places(self, path: str) -> list[tuple[int, int]]:
        """(offset in the file, bytes) of a stream's parts in order."""
        _, _, start, size, *_ = self.entries[self.streams[path]]
        if not size:
            return []
        if size >= CUTOFF:
            width, at = self.size, [self._sector(k) for k in self._chain(start, self.fat)]
        else:
            width, per = self.small, self.size // self.small
            chain = self._chain(start, self.mini)
            if chain and max(chain) // per >= len(self.root_sectors):
                raise Broken("a small sector beyond the end")
            at = [self._sector(self.root_sectors[k // per]) + k % per * width for k in chain]
        need = -(-size // width)
        if len(at) < need:
            raise Broken("a stream is cut short")
        return [(a, min(width, size - k * width)) for k, a in enumerate(at[:need])]

    def read(self, path: str) -> bytes:
        if path not in self.streams:
            raise Broken(f"no stream {path}")
        return b"".join(self.data[a : a + n] for a, n in self.places(path))

    def written(self, changes: dict[str, bytes]) -> bytes:
        """The file with streams overwritten by others of the same length."""
        out = bytearray(self.data)
        for path, new in changes.items():
            done = 0
            for a, n in self.places(path):
                out[a : a + n] = new[done : done + n]
                done += n
            if done != len(new):
                raise Broken(f"{path}: a stream keeps its length")
        return bytes(out)

    def rebuilt(self, changes: dict[str, bytes]) -> bytes:
        """A new file of the same streams, some of them others, of any length."""
        return compound({path: changes[path] if path in changes else self.read(path) for path in self.streams})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of these streams; folders in their paths become storages."""
    size, small = 512, 64
    entries: list[dict] = [{"name": "Root Entry", "kind": ROOT, "children": [], "data": b""}]
    folders = {"": 0}
    for path, data in streams.items():
        *above, name = path.split("/")
        folder = ""
        for part in above:
            inner = f"{folder}{part}/"
            if inner not in folders:
                folders[inner] = len(entries)
                entries[folders[folder]]["children"].append(len(entries))
                entries.append({"name": part, "kind": STORAGE, "children": [], "data": b""})
            folder = inner
        entries[folders[folder]]["children"].append(len(entries))
        entries.append({"name": name, "kind": STREAM, "children": [], "data": data})

    def tree(children: list[int]) -> int:
        """Siblings as a balanced tree, by length and upper-case name."""
        if not children:
            return FREE
        middle = len(children) // 2
        own = entries[children[middle]]
        own["left"], own["right"] = tree(children[:middle]), tree(children[middle + 1 :])
        return children[middle]

    for own in entries:
        order = sorted(own["children"], key=lambda k: (len(entries[k]["name"].encode("utf-16le")), entries[k]["name"].upper()))
        own["child"] = tree(order)
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        """Appends a chain of sectors; its first."""
        if not data:
            return END
        first, n = len(sectors), -(-len(data) // size)
        sectors.extend(data[k * size : (k + 1) * size].ljust(size, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), END])
        return first

    mini, mini_fat = b"", []
    for own in entries:
        data = own["data"]
        if own["kind"] != STREAM:
            own["start"] = 0
        elif len(data) >= CUTOFF or not data:
            own["start"] = put(data)
        else:
            n = -(-len(data) // small)
            own["start"] = len(mini_fat)
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), END]
            mini += data.ljust(n * small, b"\0")
    entries[0]["start"], entries[0]["data"] = put(mini), mini
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-4 * len(mini_fat) // size) * size, b"\xff"))
    directory = b""
    for own in entries:
        name = own["name"].encode("utf-16le")[:62]
        directory += name.ljust(64, b"\0") + struct.pack("<HBB", len(name) + 2, own["kind"], 1) + struct.pack("<III", own.get("left", FREE), own.get("right", FREE), own["child"]) + bytes(36) + struct.pack("<IQ", own["start"], len(own["data"]))
    empty = bytes(64) + struct.pack("<HBB", 0, 0, 0) + struct.pack("<III", FREE, FREE, FREE) + bytes(48)
    first_dir = put(directory + empty * (-len(directory) // 128 % (size // 128)))
    n_fat = n_difat = 0
    while (need := -(-(len(sectors) + n_fat + n_difat) // (size // 4))) > n_fat or -(-max(n_fat - 109, 0) // 127) > n_difat:
        n_fat, n_difat = max(need, n_fat), -(-max(max(need, n_fat) - 109, 0) // 127)
    at = len(sectors)
    fat += [FAT] * n_fat + [DIFAT] * n_difat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    where = [*range(at, at + n_fat)]
    more = b""
    for k in range(n_difat):
        part = where[109 + 127 * k : 109 + 127 * (k + 1)]
        more += struct.pack("<128I", *part, *[FREE] * (127 - len(part)), at + n_fat + k + 1 if k + 1 < n_difat else END)
    header = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, CUTOFF, first_mini if mini_fat else END, -(-4 * len(mini_fat) // size), at + n_fat if n_difat else END, n_difat)
    header += struct.pack("<109I", *(where[:109] + [FREE] * (109 - min(len(where), 109))))
    return header + b"".join(sectors) + table + more
