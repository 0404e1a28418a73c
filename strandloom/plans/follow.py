"""Reads of one chromosome followed through its exons: vote, seeds, candidates, purification and verification of a read at a time.

The rules are those of the tables in ``detect`` (strand_vote, seed_hits, candidates, purified, verified), which hold for each read
on each chromosome by itself. Here only the k-mers that the reads at hand ask for are looked up, and no table of nodes is made.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

from ..operators.links import TERMINAL_LONG, TERMINAL_SHORT, reach
from ..operators.seeds import seed_offsets
from .walk import supports

_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_BASES = frozenset("ACGT")
SAMPLES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
#: Two nodes beside the seeds that tell candidates of equal counts apart.
EXTRA = (0.15, 0.85)
#: Bases of a chromosome's exons up to which all their windows are held, so that most reads that don't belong there are left early.
AT_HAND = 50_000
#: Exons of which the links are kept for the next read.
LINKED = 256


class Exon(NamedTuple):
    gene_id: object
    tx_id: object
    exon_no: object
    start_pos: int
    end_pos: int
    strand: str
    head_signal: bool
    tail_signal: bool
    seq: str


class Chromosome:
    """The exons of a chromosome in order of gene, transcript and number, all of them; those with a signal have nodes."""

    def __init__(self, exons: list[Exon], read_length: int, k: int, ratio: float) -> None:
        self.exons, self.read_length, self.k, self.ratio, self.b = exons, read_length, k, ratio, reach(read_length, k)
        self.parts = {i: p for i, e in enumerate(exons) if (e.head_signal or e.tail_signal) and (p := self._parts(e))}
        self.at: dict[str, list[tuple[int, int, int]]] = {}
        self.linked: dict[int, dict[str, list]] = {}
        texts = [p for parts in self.parts.values() for p in parts]
        self.nodes = {p[i : i + k] for p in texts for i in range(len(p) - k + 1)} if sum(map(len, texts)) <= AT_HAND else None

    def _parts(self, e: Exon) -> list[str]:
        s, k, b = e.seq.upper(), self.k, self.b
        if len(s) < k:
            return []
        parts = [s] if len(s) <= 2 * b else [s[:b], s[len(s) - b :]]
        return parts if all(_BASES.issuperset(p[:k]) for p in parts) else []

    def look_up(self, wanted: set[str]) -> None:
        """Where the wanted k-mers lie: exon, segment, position."""
        k, at = self.k, defaultdict(list)
        for i, parts in self.parts.items():
            for n, part in enumerate(parts):
                for pos in range(len(part) - k + 1):
                    if (x := part[pos : pos + k]) in wanted:
                        at[x].append((i, n, pos))
        self.at = at

    def tag(self, i: int, segment: int, pos: int) -> str:
        """See short_tags and long_tags."""
        k, b, n = self.k, self.b, len(self.exons[i].seq)
        if n > 2 * b:
            if segment == 0:
                return "H" if pos < TERMINAL_LONG else "S"
            return "T" if pos > b - k - TERMINAL_LONG else "E"
        split = (n - k) // 2
        rest = n - split - k
        head = split + 1 if split < TERMINAL_SHORT else TERMINAL_SHORT
        tail = rest if rest < TERMINAL_SHORT else TERMINAL_SHORT
        return "H" if pos < head else "T" if pos > n - k - tail else "S" if pos <= split else "E"

    def beside(self, i: int, segment: int, pos: int, step: int) -> str | None:
        """The node after (step 1) or before (step -1) on the segment; windows with other letters are bridged over."""
        part, k = self.parts[i][segment], self.k
        pos += step
        while 0 <= pos <= len(part) - k:
            if _BASES.issuperset(x := part[pos : pos + k]):
                return x
            pos += step
        return None

    def links(self, i: int) -> dict[str, list]:
        """Per k-mer the nodes it has on the exon: (before, after, tag)."""
        if i in self.linked:
            return self.linked[i]
        if len(self.linked) >= LINKED:
            self.linked.clear()
        out = self.linked[i] = {}
        for n, part in enumerate(self.parts[i]):
            at = [(pos, x) for pos in range(len(part) - self.k + 1) if _BASES.issuperset(x := part[pos : pos + self.k])]
            for j, (pos, x) in enumerate(at):
                out.setdefault(x, []).append((at[j - 1][1] if j else None, at[j + 1][1] if j + 1 < len(at) else None, self.tag(i, n, pos)))
        return out

    def follow(self, reads: Iterable[tuple[object, str]]) -> Iterator[tuple]:
        """(read_id, circ_type, orient, seq in that orientation, donor, acceptor) of the reads (read_id, seq) that run over junctions;
        donor and acceptor are exons."""
        k, ways = self.k, []
        wanted: set[str] = set()
        for read_id, seq in reads:
            back = seq[::-1].translate(_COMPLEMENT)
            n = len(seq)
            if not (self._seeded(seq) or self._seeded(back)):
                continue
            spots = [int(np.float32(n) * np.float32(x)) for x in SAMPLES] if not ways or len(ways[-1][1]) != n else spots
            picks = [p for p in spots if p + k <= n]
            more = [int((n - k) * x) for x in EXTRA]
            seeds = [o for o in seed_offsets(k) if o <= n - k]
            ends = [o for o in (n - k - o for o in seed_offsets(k)) if o >= 0]
            for s in (seq, back):
                wanted.update([s[p : p + k] for p in (*seeds, *ends, *more)])
            wanted.update([seq[p : p + k] for p in picks])
            wanted.update([seq[p : p + k][::-1].translate(_COMPLEMENT) for p in picks])
            ways.append((read_id, seq, back, picks))
        self.look_up(wanted)
        for read_id, seq, back, picks in ways:
            f = sum(seq[p : p + k] in self.at for p in picks)
            r = sum(seq[p : p + k][::-1].translate(_COMPLEMENT) in self.at for p in picks)
            orient = "+" if f >= 3 or f >= r and f >= 2 else "-" if r >= 2 else None
            if orient:
                s = seq if orient == "+" else back
                for c in self._purified(self._candidates(self._hits(s)), s):
                    kind, d, a, signal = c[:4]
                    if (kind == "S" or self.exons[d].seq != self.exons[a].seq) and (kind == "R" or signal) and supports(s, self.links(d), self.links(a), kind == "S", k, self.ratio):
                        yield read_id, kind, orient, s, self.exons[d], self.exons[a]

    def _seeded(self, s: str) -> bool:
        """Whether two seeds of the head and two of the tail may be nodes; without these there are no hits."""
        k, last = self.k, len(s) - self.k
        if self.nodes is None:
            return True
        for head in (True, False):
            at = [o if head else last - o for o in seed_offsets(k)]
            if sum(0 <= p <= last and s[p : p + k] in self.nodes for p in at) < 2:
                return False
        return True

    def _hits(self, s: str) -> tuple[dict[int, list[str]], dict[int, list[str]]]:
        """Exons hit by most seeds of the head and of the tail, two at least, with the tags of the first seed there. None where two
        exons of one transcript on one side are: the read doesn't tell them apart."""
        k, last, found = self.k, len(s) - self.k, []
        for head in (True, False):
            n, first = Counter(), {}
            for o in seed_offsets(k):
                at = o if head else last - o
                if not 0 <= at <= last or (x := s[at : at + k]) not in self.at:
                    continue
                here = self.at[x]
                near = self.beside(*here[0], 1 if head else -1)
                if near is None or near not in (s[at:] if head else s[: at + k]):
                    continue
                for i in dict.fromkeys(i for i, _, _ in here):
                    n[i] += 1
                    first.setdefault(i, x)
            best = max(n.values(), default=0)
            if best < 2:
                return {}, {}
            side = {i: [self.tag(*p) for p in self.at[first[i]] if p[0] == i] for i, m in n.items() if m == best}
            if len({self.exons[i][:2] for i in side}) < len(side):
                return {}, {}
            found.append(side)
        return found[0], found[1]

    def _candidates(self, hits: tuple[dict[int, list[str]], dict[int, list[str]]]) -> list[tuple]:
        """(kind, donor, acceptor, signal, links): one exon's end to its own start, a later one's to an earlier one's start."""
        out, room = [], 2 * (self.read_length - self.k + 1)
        by = {self.exons[a][:2]: (a, tags) for a, tags in hits[1].items()}
        length = lambda e: e.end_pos - e.start_pos + 1
        for d, d_tags in hits[0].items():
            if self.exons[d][:2] not in by:
                continue
            a, a_tags = by[self.exons[d][:2]]
            de, ae = self.exons[d], self.exons[a]
            back = de.exon_no < ae.exon_no if de.strand == "-" else de.exon_no > ae.exon_no
            signal = bool(de.tail_signal or ae.head_signal)
            if any(t in "HS" for t in a_tags):
                if d == a or back:
                    out.append(("S" if d == a else "R", d, a, signal, len(d_tags)))
            elif back and de.tail_signal and ae.head_signal:
                n = len(d_tags) if a_tags[0] in "TE" and length(ae) <= room else sum(t in "HS" for t in d_tags) if length(de) <= room else 0
                if n:
                    out.append(("R", d, a, signal, n))
        return out

    def _purified(self, cands: list[tuple], s: str) -> list[tuple]:
        """At most two candidates per kind: those with most links, then most extra nodes."""
        ex, k = self.exons, self.k
        length = lambda i: ex[i].end_pos - ex[i].start_pos + 1

        def repeat(c: tuple) -> bool:
            d = c[1]
            return any(0 <= x < len(ex) and ex[x][:2] == ex[d][:2] and length(x) == length(d) for x in (d - 1, d + 1))

        regular, selfs = sum(c[0] == "R" for c in cands), sum(c[0] == "S" for c in cands)
        if regular == selfs == 1 and any(c[0] == "R" and abs(ex[c[1]].exon_no - ex[c[2]].exon_no) == 1 for c in cands):
            return []
        cands = [c for c in cands if not (c[0] == "S" and selfs == 1 and repeat(c))] if selfs == 1 else cands
        on = [{i for i, _, _ in self.at.get(s[at : at + k], ())} for at in {int((len(s) - k) * x) for x in EXTRA}]
        out = []
        for kind in ("R", "S"):
            of = [(*c, sum(c[1] in x or c[2] in x for x in on)) for c in cands if c[0] == kind]
            if not of:
                continue
            best = max(c[4:] for c in of)
            pair = kind == "R" and len(of) == 2 and min(c[5] for c in of) == 2 and best[0] - min(c[4] for c in of) <= 2
            of = [c for c in of if len(of) == 1 or pair or c[4:] == best]
            if len(of) <= 2 and not (kind == "S" and len(of) == 2 and len({length(c[1]) for c in of}) == 1):
                out += of
        return out
