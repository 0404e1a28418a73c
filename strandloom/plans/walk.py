"""Following one read through the links of its donor and acceptor exon. A small per-read check, run inside tasks."""

from __future__ import annotations

LEAST_STEPS = 5


def _third_match(a: str, b: str, k: int) -> bool:
    t = k // 3
    return len(a) == len(b) == k and sum(a[i * t : i * t + t] == b[i * t : i * t + t] for i in range(3)) >= 2


def _walk(links: dict[str, list], start: str, forward: bool, limit: int) -> tuple[int, int, list[tuple[str, str]]]:
    """(result, steps, saved nodes) from ``start`` along the exon to its terminal end.

    ``links`` has per k-mer (pre, next, tag, gate tag). Result 0: the end was reached; 2: a node isn't on the
    exon; -1: longer than the read.
    """
    wanted, end = ({"E", "T"}, "T") if forward else ({"S", "H"}, "H")
    node, left, saved, step = start, None, [], 0
    while True:
        step += 1
        if step > limit:
            return -1, step, saved
        here = links.get(node)
        if not here:
            return 2, step, saved
        link = next((x for x in here if left is not None and (x[0] if forward else x[1]) == left), here[0])
        following = link[1] if forward else link[0]
        tag, last = link[2], following is None
        if tag in wanted and (not saved or step < 3 or step % 3 == 0 or last):
            saved.append((node, tag))
        if last:
            return (0 if tag == end else 2), step, saved
        left, node = node, following


def _match(read: str, saved: list[tuple[str, str]], forward: bool, k: int, shift: bool) -> tuple[int, int | None, set[str]]:
    """(hits, position of the cursor, tags seen) of saved nodes met in the read in order; terminal nodes may match
    loosely, until that fails once."""
    cursor = 0 if forward else len(read)
    hits, seen, loose, at = 0, set(), True, None
    for i, (node, tag) in enumerate(saved):
        found = read.find(node, cursor) if forward else read.rfind(node, 0, min(len(read), cursor + k))
        if found >= 0:
            hits, cursor, at = hits + 1, found, found
            seen.add(tag)
        elif loose and at is not None:
            to = cursor + (3 if forward else -3)
            if tag in "TH":
                if 0 <= to <= len(read) - k and _third_match(read[to : to + k], node, k):
                    hits, cursor, at = hits + 1, to, to
                    seen.add(tag)
                else:
                    loose = False
            elif shift and i > 3:
                cursor = max(0, to)
    return hits, at, seen


def supports(read: str, donor: dict[str, list], acceptor: dict[str, list], is_self: bool, k: int, ratio: float = 0.6) -> bool:
    """Whether the read runs off the end of the donor exon into the beginning of the acceptor exon.

    ``ratio``: of a read's nodes that should be met; two fifths of these must be saved on the way.
    """
    n = len(read) - k + 1
    first = next((read[i : i + k] for i in range(n) if read[i : i + k] in donor), None)
    last = next((read[i : i + k] for i in range(n - 1, -1, -1) if read[i : i + k] in acceptor), None)
    if first is None or last is None:
        return False
    to_tail = _walk(donor, first, True, len(read))
    to_head = _walk(acceptor, last, False, len(read))
    if min(to_tail[1], to_head[1]) < LEAST_STEPS:
        return False
    tail_saved, head_saved = to_tail[2], to_head[2]
    if len(tail_saved) + len(head_saved) < int(n * ratio * 0.4):
        if sum(t == "T" for _, t in tail_saved) < 2 or sum(t == "H" for _, t in head_saved) < 2:
            return False
    tail = _match(read, tail_saved, True, k, not is_self) if to_tail[0] == 0 else (0, None, set())
    head = _match(read, head_saved, False, k, not is_self) if to_head[0] == 0 else (0, None, set())

    def good(got: tuple, saved: list, both: set[str], is_tail: bool) -> bool:
        hits, total = got[0], len(saved)
        if hits >= 0.8 * total:
            return True
        if is_self:
            return total > k and hits >= total - k and got[2] >= both
        low = 0.6 * k
        return total > low and hits >= total - (low if is_tail else k) and got[2] >= both

    if not good(tail, tail_saved, {"T", "E"}, True) or not good(head, head_saved, {"H", "S"}, False):
        return False
    return tail[1] is not None and head[1] is not None and abs(tail[1] + k - head[1]) < 2
