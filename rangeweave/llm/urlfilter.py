"""URL filters on a sorted digest array.

Every rule's host + path is hashed with 64-bit xxhash. The sorted keys, the offsets and the full
strings go to one file that ``SparkContext.addFile`` brings to each executor once; its workers
memory-map it and share its pages. A page's candidate strings (host suffixes of as many labels as some
rule's host has, path prefixes as long as some rule's path) are probed together by a binary search
over the array, so a page's work follows its length times the rules' kinds, however many labels its
host has. A hit counts when the stored string is the probed one, so digest collisions cannot decide.
Rules are a parameter, of at most ``MAX_RULES``; the driver sorts them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: (verdict, host, path) of the query; a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The verdict of a page that no rule fits.
DEFAULT = "allow"
_HEAD = 4  # of the file: int64 rules, hosts' label counts, path lengths, bytes of strings
MAX_RULES = 10_000_000


def write_digests(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """The file: keys sorted, then per key host length, verdict, string's end; path lengths; hosts' label counts; strings.

    A rule given twice keeps its last verdict. Rules may come from any iterator; only distinct
    strings are kept.
    """
    last = {(h + p): (v, len(h.encode())) for v, h, p in rules}
    if len(last) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    raw = [(xxhash.xxh64_intdigest(s), s.encode(), v, n) for s, (v, n) in last.items()]
    raw.sort()
    lengths = sorted({len(s.decode()) - len(s[:n].decode()) for _, s, _, n in raw})
    labels = sorted({s[:n].decode().count(".") + 1 for _, s, _, n in raw})
    with open(path, "wb") as f:
        np.array([len(raw), len(labels), len(lengths), sum(len(s) for _, s, _, _ in raw)], dtype="<i8").tofile(f)
        np.array([k for k, *_ in raw], dtype="<u8").tofile(f)
        np.array([n for *_, n in raw], dtype="<i8").tofile(f)
        np.array([v == "allow" for _, _, v, _ in raw], dtype="<i8").tofile(f)
        np.array(np.cumsum([len(s) for _, s, _, _ in raw]), dtype="<i8").tofile(f)
        np.array(lengths, dtype="<i8").tofile(f)
        np.array(labels, dtype="<i8").tofile(f)
        f.write(b"".join(s for _, s, _, _ in raw))


class Digests:
    """The memory-mapped file."""

    def __init__(self, path: str):
        m = np.memmap(path, dtype="u1", mode="r")
        n, k, p, _ = m[: 8 * _HEAD].view("<i8")
        parts = np.split(m[8 * _HEAD : 8 * (_HEAD + 4 * n + p + k)], 8 * np.array([n, 2 * n, 3 * n, 4 * n, 4 * n + p]))
        self.keys = parts[0].view("<u8")
        self.host, self.allow, self.end, self.lengths, self.labels = (x.view("<i8") for x in parts[1:])
        self.strings = m[8 * (_HEAD + 4 * n + p + k) :]
        self.lengths, self.labels = self.lengths.tolist(), self.labels.tolist()

    def suffixes(self, host: str) -> list[str]:
        """Those of host that have as many labels as some rule's host."""
        parts = host.rsplit(".", self.labels[-1]) if self.labels else []
        whole = len(parts) <= (self.labels[-1] if self.labels else 0)  # else parts[0] is what is left of the host
        return [".".join(parts[-n:]) for n in self.labels if n <= len(parts) - (not whole)]

    def find(self, probes: list[str], hosts: list[int]) -> np.ndarray:
        """The rule of each probe whose string and host length are those stored, else -1."""
        if not len(self.keys) or not probes:
            return np.full(len(probes), -1)
        h = np.fromiter((xxhash.xxh64_intdigest(s) for s in probes), dtype="<u8", count=len(probes))
        first, last = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
        out = np.full(len(probes), -1)
        for i in np.nonzero(first < last)[0]:
            for at in range(first[i], last[i]):
                lo = self.end[at - 1] if at else 0
                if self.host[at] == hosts[i] and self.strings[lo : self.end[at]].tobytes() == probes[i].encode():
                    out[i] = at
        return out

    def text(self, at: int) -> str:
        return self.strings[self.end[at - 1] if at else 0 : self.end[at]].tobytes().decode()


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    Null url or one without "://": empty host and path, no rule, the default verdict. Among the
    rules that fit, the longest host + path wins, then the longer host. No rules: all default.
    """
    spark = pages.sparkSession
    small_batches(spark)
    name = f"digests-{uuid.uuid4().hex}.bin"
    write_digests(rules, at := os.path.join(tempfile.mkdtemp(), name))
    spark.sparkContext.addFile(at)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    split = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for b in batches:
            probes, owner, lengths = [], [], []
            for i, (h, p) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                for tail in digests.suffixes(h):
                    for n in digests.lengths:
                        if n <= len(p):
                            probes.append(tail + p[:n])
                            owner.append(i)
                            lengths.append(len(tail.encode()))
            best: dict[int, tuple[int, int, int]] = {}
            found = digests.find(probes, lengths)
            for j in np.nonzero(found >= 0)[0]:
                best[owner[j]] = max(best.get(owner[j], (-1, -1, -1)), (len(probes[j]), lengths[j], int(found[j])))
            hit = [best.get(i, (0, 0, -1))[2] for i in range(b.num_rows)]
            rule = pa.array([digests.text(x) if x >= 0 else None for x in hit], pa.string())
            verdict = pa.array([("block", "allow")[digests.allow[x]] if x >= 0 else default for x in hit], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
