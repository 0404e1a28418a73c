"""Run settings from an INI file, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


def read_ini(path: str | Path) -> dict[str, dict[str, str]]:
    """Sections of key=value lines. Blank lines and lines that begin with # are skipped, values aren't trimmed."""
    sections: dict[str, dict[str, str]] = {}
    current = sections.setdefault("", {})
    for line in Path(path).read_text().splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if line.startswith("[") and line.rstrip().endswith("]"):
            current = sections.setdefault(line.strip()[1:-1], {})
        elif "=" in line:
            key, value = line.split("=", 1)
            current[key] = value
    return {k: v for k, v in sections.items() if k or v}


# Keys of run files and the settings they stand for.
KEYS = {
    "gtf": "annotation", "kmerlen": "kmer_length", "readlen": "read_length", "kmerratio": "kmer_ratio", "maxsupportnum": "max_support",
    "dodetection": "detect", "docomparison": "compare", "circrnadb": "database", "simulatorbenchmark": "truth",
}
# What keys of result files (a tool's name and "Result") are named here where that isn't the name itself.
CALL_SETS = {"my": "dbg", "findcirc": "find_circ", "circrnafinder": "circrna_finder", "circrnadb": "database"}


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a run; ratios are shares of 1."""

    reference: str = ""
    annotation: str = ""
    reads: tuple[str, ...] = ()
    kmer_length: int = 15
    read_length: int = 101
    kmer_ratio: float = 0.6
    max_support: int = 999
    detect: bool = True
    compare: bool = False
    database: str = ""
    tissue: str = ""
    truth: str = ""
    call_sets: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_ini(path: str | Path) -> EngineConfig:
        """Keys as fields of this class or as in ``KEYS``, in any section and case, ``kmer_ratio`` in percent; [call_sets]
        maps tools to paths, as do keys that end in Result. A key that is none of these raises ValueError."""
        ini = read_ini(path)
        flat = {KEYS.get(k.strip().lower(), k.strip().lower()): v.strip() for name, s in ini.items() if name != "call_sets" for k, v in s.items()}
        sets = {k.strip(): v.strip() for k, v in ini.get("call_sets", {}).items()} | {CALL_SETS.get(k[:-6], k[:-6]): v for k, v in flat.items() if k.endswith("result") and v}
        if unknown := {k for k in flat if not k.endswith("result")} - {f.name for f in fields(EngineConfig)} - {"reads1", "reads2", "threadsnum"}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        reads = [*flat.get("reads", "").split(","), flat.get("reads1", ""), flat.get("reads2", "")]
        yes = lambda k, default: flat.get(k, default).lower() in ("1", "true", "yes")
        return EngineConfig(
            reference=flat.get("reference", ""),
            annotation=flat.get("annotation", ""),
            reads=tuple(x.strip() for x in reads if x.strip()),
            kmer_length=int(flat.get("kmer_length", 15)),
            read_length=int(flat.get("read_length", 101)),
            kmer_ratio=float(flat.get("kmer_ratio", 60)) / 100,
            max_support=int(flat.get("max_support", 999)),
            detect=yes("detect", "1"),
            compare=yes("compare", "0"),
            database=flat.get("database", ""),
            tissue=flat.get("tissue", ""),
            truth=flat.get("truth", ""),
            call_sets=sets,
        ).checked()

    def checked(self) -> EngineConfig:
        if not 1 <= self.kmer_length <= 31:
            raise ValueError("kmer_length must be from 1 to 31")
        if self.read_length < 2 * self.kmer_length:
            raise ValueError("read_length must be two k-mers at least")
        if self.max_support < 1:
            raise ValueError("max_support must be 1 at least")
        if not 0 < self.kmer_ratio <= 1:
            raise ValueError("kmer_ratio must be above 0 and at most 100 percent")
        return self
