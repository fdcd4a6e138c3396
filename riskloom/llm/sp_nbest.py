"""N-best segmentation into the pieces of a SentencePiece vocabulary, and back.

Every piece has a score; a segmentation's score is the sum. A forward
Viterbi pass gives the best (score, number of ids) of reaching each
position; these are exact heuristics for a backward A* search from the
end, so complete segmentations leave the heap in their final order: score
descending, fewer ids, then ids read from the end. A character that no
piece spells scores ten below the least piece and is written as byte
pieces.

A text is cut between two characters that stand next to each other in no
piece (no piece can cross there). Parts are independent, so the N best of a
text are combinations of its parts' N best in which at most N - 1 cheapest
replacements take part. The distinct parts of a slice of texts are searched
together in numpy: the forward pass position by position, then the backward
search, which in each round expands the up to N + 1 open states of least
(cost so far + heuristic) of every part. Heuristics are exact, so states
beyond these lead to no N best segmentation. Parts with equal costs among
their N + 1 best, and very long parts, are searched one by one by a heap,
which settles the order of equal costs.

Edge cases: null and empty texts have one segmentation, the empty one; a
text with fewer than N segmentations has them all; equal scores follow
the order above; white space other than the space is spelt in byte
pieces; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import distinct_spans, document_of, ragged_take, slices

SPACE = "▁"
#: characters of a part that is still searched together with others
LONGEST = 128
#: bytes of text whose distinct parts are found together, and parts that are searched together
SLICE, BLOCK = 8 << 20, 1 << 14
#: bytes of text whose segmentations make one result batch
OUTPUT = 1 << 20
RESULT = ("doc_id long, n_chars long, n_best int, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, "
          "ids array<array<int>>, decoded array<string>, restored array<boolean>")


class PieceTable:
    """Pieces and scores of a vocabulary, read through its library.

    Costs are whole numbers, so sums are exact and one comparison orders by score and
    then by the number of ids: -score in steps of 2**-16, times ``STEP``, plus the ids.
    """

    STEP = 1 << 24
    #: the same in 64 bits for parts of at most ``LONGEST`` characters (at most 4 ids each)
    SHORT = 10

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {p: (self.cost(sp.get_score(i), 1), (i,)) for i, p in enumerate(self.pieces)
                    if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelt = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.spelt[i] = bytes([b])
        self.unknown = min(sp.get_score(ids[0]) for _, ids in self.ids.values()) - 10
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._arrays()

    def _arrays(self) -> None:
        """The same for numpy: pairs as sorted numbers; the trie's steps as sorted numbers
        (state, character) with the state reached, and each state's piece (or -1) and cost."""
        number = lambda a, b: (a << 21) | b
        self.pair_keys = np.array(sorted(number(ord(p[0]), ord(p[1])) for p in self.pairs) or [-1], np.int64)
        ascii_pairs = self.pair_keys[(self.pair_keys >> 21 < 128) & (self.pair_keys & 0x1FFFFF < 128) & (self.pair_keys >= 0)]
        self.ascii_pair = np.zeros(1 << 14, bool)
        self.ascii_pair[(ascii_pairs >> 21 << 7) | (ascii_pairs & 127)] = True
        names = sorted(self.prefixes)
        states = {"": 0} | {p: i + 1 for i, p in enumerate(names)}
        keys = np.array([number(states[p[:-1]], ord(p[-1])) for p in names], np.int64)
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], order + 1
        found = [self.ids.get(p, (0, (-1,))) for p in ["", *names]]
        self.state_cost = np.array([self.short(c) for c, _ in found], np.int64)
        self.state_piece = np.array([i[0] for _, i in found], np.int64)
        # sums of a part's costs stay below 2**62
        self.longest = min(LONGEST, (1 << 62) // max(self.short(self.cost(self.unknown, 4)), 1))

    @classmethod
    def cost(cls, score: float, ids: int) -> int:
        return round(-score * 65536) * cls.STEP + ids

    @classmethod
    def short(cls, cost: int) -> int:
        return (cost // cls.STEP << cls.SHORT) + cost % cls.STEP

    @classmethod
    def score(cls, cost: int) -> float:
        return -(cost // cls.STEP) / 65536

    def edges(self, text: str) -> list[list[tuple[int, int, tuple]]]:
        """For each end position the (start, cost, ids from the last) of its pieces."""
        size, ids, prefixes = len(text), self.ids, self.prefixes
        ends: list[list] = [[] for _ in range(size + 1)]
        for a in range(size):
            for b in range(a + 1, size + 1):
                piece = text[a:b]
                if piece not in prefixes:
                    break
                if piece in ids:
                    ends[b].append((a, *ids[piece]))
            if text[a] not in ids:
                spelt = tuple(self.bytes[x] for x in reversed(text[a].encode()))
                ends[a + 1].append((a, self.cost(self.unknown, len(spelt)), spelt))
        return ends

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple]]:
        """(cost, ids from the last to the first) of the best segmentations, in order."""
        ends = self.edges(text)
        best = [0]  # least cost of reaching a position
        for incoming in ends[1:]:
            best.append(min([best[a] + c for a, c, _ in incoming]))
        out: list[tuple[int, tuple]] = []
        left = [n] * len(best)  # the n best ways to the end suffice at each position
        heap = [(best[-1], (), len(text), 0)]  # cost in all, ids so far, position, cost so far
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, ids, at, done = pop(heap)
            if at == 0:
                out.append((done, ids))
                if len(out) == n:
                    break
            elif left[at]:
                left[at] -= 1
                for a, c, own in ends[at]:
                    push(heap, (best[a] + done + c, ids + own, a, done + c))
        return out

    def neighbours(self, chars: np.ndarray) -> np.ndarray:
        """Whether each character and the next one stand next to each other in some piece."""
        left, right = chars[:-1], chars[1:]
        out = self.ascii_pair[((left & 127) << 7) | (right & 127)]
        other = np.flatnonzero((left | right) >= 128)
        out[other] = member(self.pair_keys, (left[other].astype(np.int64) << 21) | right[other]) >= 0
        return out

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte pieces spelt out, the first space dropped."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def member(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in sorted ``keys``, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Lattices:
    """Piece lattices of many parts. Part p has a node before each of its characters and
    one at its end; an edge is a piece (or a character's byte pieces) between two nodes."""

    def __init__(self, table: PieceTable, chars: np.ndarray, sizes: np.ndarray):
        self.table, self.sizes = table, sizes
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)
        self.first = ends - sizes + np.arange(len(sizes))
        self.last = self.first + sizes
        start, stop, cost, spelling = self._edges(chars, ends[part])
        self.start, end = start + part[start], stop + part[start]
        depth = end - self.first[part[start]]
        order = np.argsort((depth << 40) | end)
        self.start, self.cost, self.spelling = self.start[order], cost[order], spelling[order]
        end, depth = end[order], depth[order]
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        self.head = np.zeros(len(chars) + len(sizes), np.int64)
        self.degree = np.zeros(len(self.head), np.int64)
        self.head[end[heads]] = heads
        self.degree[end[heads]] = np.diff(heads, append=len(end))
        # forward Viterbi: least cost of reaching each node, all parts' nodes of one depth at a time
        self.best = np.zeros(len(self.head), np.int64)
        levels = np.searchsorted(depth[heads], np.arange(1, (int(sizes.max()) if len(sizes) else 0) + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            lo, hi = heads[a], heads[b] if b < len(heads) else len(end)
            self.best[end[heads[a:b]]] = np.minimum.reduceat(
                self.best[self.start[lo:hi]] + self.cost[lo:hi], heads[a:b] - lo)

    def _edges(self, chars, ends):
        """(first character, character after, cost, row of the spellings) of each edge."""
        table, found = self.table, []
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        length, alone = 0, np.ones(len(chars), bool)
        while len(at):
            step = member(table.step_keys, (state << 21) | chars[at + length])
            at, state = at[step >= 0], table.step_to[step[step >= 0]]
            length += 1
            piece = table.state_piece[state]
            whole = piece >= 0
            if length == 1:
                alone[at[whole]] = False
            found.append((at[whole], at[whole] + length, table.state_cost[state[whole]], piece[whole]))
            more = at + length < ends[at]
            at, state = at[more], state[more]
        lone = np.flatnonzero(alone)
        unknown, which = np.unique(chars[lone], return_inverse=True)
        spelt = [[table.bytes[b] for b in chr(c).encode()] for c in unknown.tolist()]
        widths = np.array([len(x) for x in spelt], np.int64)
        prices = np.array([table.short(table.cost(table.unknown, len(x))) for x in spelt], np.int64)
        size = len(table.pieces)
        self.ids = np.concatenate([np.arange(size), np.array(list(itertools.chain(*spelt)), np.int64)]).astype(np.uint32)
        self.ids_at = np.concatenate([np.arange(size + 1), size + np.cumsum(widths)])
        found.append((lone, lone + 1, prices[which], size + which))
        return [np.concatenate(c) for c in zip(*found)]

    def search(self, n: int) -> None:
        """Backward search from every part's end. Afterwards ``done`` has (part, cost, state)
        of complete segmentations by part and cost, ``tied`` the parts with equal costs."""
        count = len(self.sizes)
        self.tied = np.zeros(count, bool)
        part, node, done = np.arange(count), self.last.copy(), np.zeros(count, np.int64)
        state = np.arange(count)
        self.parent, self.edge = [np.full(count, -1)], [np.full(count, -1)]
        made, finished = count, []
        while len(part):
            complete = node == self.first[part]
            fan = np.where(complete, 1, self.degree[node])
            old = np.repeat(np.arange(len(part)), fan)
            edge = np.arange(len(old)) - np.repeat(np.cumsum(fan) - fan, fan) + self.head[node[old]]
            edge[complete[old]] = 0
            fresh = ~complete[old]
            part, before = part[old], state[old]
            node = np.where(fresh, self.start[edge], node[old])
            done = done[old] + np.where(fresh, self.cost[edge], 0)
            keep = self._least(part, done + self.best[node], n + 1)
            part, node, done, before, edge, fresh = (x[keep] for x in (part, node, done, before, edge, fresh))
            state = before.copy()
            state[fresh] = made + np.arange(int(fresh.sum()))
            made += int(fresh.sum())
            self.parent.append(before[fresh])
            self.edge.append(edge[fresh])
            going = np.zeros(count, bool)
            going[part[node != self.first[part]]] = True
            going = going[part]
            finished.append((part[~going], done[~going], state[~going]))
            part, node, done, state = (x[going] for x in (part, node, done, state))
        self.parent, self.edge = np.concatenate(self.parent), np.concatenate(self.edge)
        part, done, state = (np.concatenate(c) for c in zip(*finished)) if finished else (part, done, state)
        order = np.lexsort((done, part))
        part, done, state = part[order], done[order], state[order]
        self.tied[part[1:][(part[1:] == part[:-1]) & (done[1:] == done[:-1])]] = True
        rank = np.arange(len(part)) - np.searchsorted(part, part)
        keep = (rank < n) & ~self.tied[part]
        self.done = part[keep], done[keep], state[keep]
        del self.start, self.cost, self.head, self.degree, self.best  # not needed to spell what was found

    def _least(self, part, whole, n: int) -> np.ndarray:
        """Places of each part's n least ``whole`` costs; parts with equal ones become tied and drop out."""
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(heads, append=len(part))
        keep = np.repeat(sizes <= n, sizes)
        places = np.flatnonzero(~keep)
        part, whole = part[places], whole[places]
        sizes = sizes[sizes > n]
        heads = np.cumsum(sizes) - sizes
        for _ in range(n if len(places) else 0):
            least = np.minimum.reduceat(whole, heads)
            hit = np.flatnonzero(whole == np.repeat(least, sizes))
            own = part[hit]
            self.tied[own[1:][own[1:] == own[:-1]]] = True
            keep[places[hit]] = True
            whole[hit] = np.iinfo(np.int64).max
        keep[places[self.tied[part]]] = False
        return np.flatnonzero(keep)

    def spell(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of complete states, one after another, and each one's number of ids."""
        steps, at = [], states
        while len(at) and (self.edge[at] >= 0).any():  # the last step taken is the text's first piece
            steps.append(self.edge[at])
            at = np.where(self.parent[at] >= 0, self.parent[at], at)
        if not steps:
            return np.zeros(0, np.uint32), np.zeros(len(states), np.int64)
        taken = np.stack(steps, axis=1)
        row, _ = np.nonzero(taken >= 0)
        ids, each = ragged_take(self.ids, self.ids_at, self.spelling[taken[taken >= 0]])
        return ids, np.bincount(row, each, len(states)).astype(np.int64)

    def ids_of(self, state: int) -> list[int]:
        """Ids of one complete state."""
        out: list[int] = []
        while (edge := self.edge[state]) >= 0:
            row = self.spelling[edge]
            out += self.ids[self.ids_at[row]:self.ids_at[row + 1]].tolist()
            state = self.parent[state]
        return out


class PartLists:
    """The n best of each distinct part: ``units`` of the best one's score (2**-16), its ids
    in ``pool``, the ``loss`` of the second (inf: none); ``of(p)`` has all (cost, ids from the last)."""

    def __init__(self, table: PieceTable, texts: list[str], n: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        together = np.flatnonzero(sizes <= table.longest)
        alone = np.flatnonzero(sizes > table.longest).tolist()
        self._step, self._blocks, found, pool, row, held = table.STEP, [], [], [], np.zeros(len(texts), np.int64), 0
        for at in range(0, len(together), BLOCK):
            own = together[at:at + BLOCK]
            chars = np.frombuffer("".join([texts[p] for p in own.tolist()]).encode("utf-32-le"), np.uint32)
            lattices = Lattices(table, chars.astype(np.int64), sizes[own])
            lattices.search(n)
            part, cost, state = lattices.done
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            row[own[part[heads]]] = held + np.arange(len(heads))
            held += len(heads)
            pool.append(lattices.spell(state[heads]))
            alone += own[lattices.tied].tolist()
            found.append((own[part], cost, state, np.full(len(part), len(self._blocks))))
            self._blocks.append(lattices)
        part, cost, self._state, self._block = (
            [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4)
        self._units, lengths = cost >> table.SHORT, cost & ((1 << table.SHORT) - 1)
        self._edge = np.searchsorted(part, np.arange(len(texts) + 1))
        self.units, self.loss = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf)
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        self.units[part[heads]] = self._units[heads]
        second = heads[np.append(part, -1)[heads + 1] == part[heads]]
        self.loss[part[second]] = ((self._units[second + 1] - self._units[second]).astype(float) * table.STEP
                                   + (lengths[second + 1] - lengths[second]))
        self.lists = {p: table.n_best(texts[p], n) for p in alone}
        for k, (p, own) in enumerate(self.lists.items()):
            (c, first), row[p] = own[0], held + k
            pool.append((np.array(first[::-1], np.uint32), np.array([len(first)])))
            self.units[p] = c // table.STEP
            if len(own) > 1:
                self.loss[p] = float(own[1][0] - c)
        ids, each = zip(*pool) if pool else ([np.zeros(0, np.uint32)], [np.zeros(0, np.int64)])
        self.pool, self.row = np.concatenate(ids), row
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(each))]).astype(np.int64)

    def of(self, p: int) -> list[tuple[int, tuple]]:
        found = self.lists.get(p)
        if found is None:
            a, b = self._edge[p], self._edge[p + 1]
            spelt = map(self._blocks[self._block[a]].ids_of, self._state[a:b].tolist())
            found = self.lists[p] = [(u * self._step + len(ids), tuple(reversed(ids)))
                                     for u, ids in zip(self._units[a:b].tolist(), spelt)]
        return found

    def above(self, p: int) -> bool:
        own = self.of(p)
        return own[1][1] > own[0][1]


def single_key(lists, place: int, alternative: int) -> tuple:
    """Order of replacing one part: loss, then ids from the end."""
    (c0, i0), (c1, i1) = lists[place][0], lists[place][alternative]
    above = i1 > i0
    return (c1 - c0, above, place if above else -place, alternative)


def replacements(lists, n: int) -> list[dict[int, int]]:
    """The n best choices as {part: alternative}, best first. Only the n - 1 cheapest
    single replacements can take part: each choice costs no less than any single in it."""
    singles = sorted((single_key(lists, p, k), p, k) for p in range(len(lists)) for k in range(1, len(lists[p])))
    singles = singles[:n - 1]
    choices = []
    for size in range(len(singles) + 1):
        for group in itertools.combinations(singles, size):
            chosen = {p: k for _, p, k in group}
            if len(chosen) == size:
                choices.append((sum(g[0][0] for g in group), chosen))

    def compare(x, y):
        if x[0] != y[0]:
            return -1 if x[0] < y[0] else 1
        for p in sorted({*x[1], *y[1]}, reverse=True):
            a, b = lists[p][x[1].get(p, 0)][1], lists[p][y[1].get(p, 0)][1]
            if a != b:
                return -1 if a < b else 1
        return 0

    return [c[1] for c in sorted(choices, key=functools.cmp_to_key(compare))[:n]]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(path)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents with the vocabulary's leading space; its own mark counts as a space."""
    if b"\xe2\x96\x81" in data.tobytes():
        texts = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets, offsets[1:])]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    return data, offsets + np.concatenate([[0], np.cumsum(full)])


def part_spans(table: PieceTable, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans between characters that are neighbours in no piece."""
    chars = np.frombuffer(data.tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[at[1:][~table.neighbours(chars)]] = True
    marks = np.flatnonzero(cut)
    return marks[:-1], marks[1:]


def segment_slice(data, offsets, path: str, n: int):
    """For each document: [(score, ids)], best first."""
    table = _table(path)
    data, offsets = spaced(data, offsets)
    starts, ends = part_spans(table, data, offsets)
    _, sample, inverse = distinct_spans(data, starts, ends)
    whole = data.tobytes()
    lists = PartLists(table, [whole[a:b].decode().replace(" ", SPACE)
                              for a, b in zip(starts[sample].tolist(), ends[sample].tolist())], n)
    flat, each = ragged_take(lists.pool, lists.at, lists.row[inverse])
    place = np.concatenate([[0], np.cumsum(each)])
    loss = lists.loss[inverse]
    units = np.concatenate([[0], np.cumsum(lists.units[inverse])])
    edges = np.searchsorted(document_of(starts, offsets), np.arange(len(offsets)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own, own_loss = inverse[a:b], loss[a:b]
        ids = flat[place[a]:place[b]]
        near = np.flatnonzero(own_loss < np.inf)
        if len(near) > n - 1:
            # a part's later alternatives cost no less than its first
            near = near[own_loss[near] <= np.partition(own_loss[near], max(n - 2, 0))[max(n - 2, 0)]]
            if len(near) > n - 1:
                up = np.array([lists.above(p) for p in own[near].tolist()])
                near = np.sort(near[np.lexsort((np.where(up, near, -near), up, own_loss[near]))[:n - 1]])
        small = [lists.of(p) for p in own[near].tolist()]
        base = int(units[b] - units[a])
        out = []
        for pick in replacements(small, n):
            pieces, upto, change = [], 0, 0
            for p, k in sorted(pick.items()):
                c, other = small[p][k]
                change += c // table.STEP - small[p][0][0] // table.STEP
                start = place[a + near[p]] - place[a]
                pieces += [ids[upto:start], np.array(other[::-1], np.uint32)]
                upto = start + len(small[p][0][1])
            out.append((-(base + change) / 65536, np.concatenate([*pieces, ids[upto:]]) if pieces else ids))
        yield out


def n_best(docs: DataFrame, vocabulary: str, n: int = 4) -> DataFrame:
    """Per document its n best segmentations, best first: scores, ids with their number and
    checksum, and the text that each decodes to; restored: it is the text again."""

    def run(batches):
        for part, data, offsets in slices(batches, limit=SLICE):
            table, out = _table(vocabulary), Segmentations()
            found = segment_slice(data, offsets, vocabulary, n)
            for doc_id, a, b, best in zip(part.column(0).to_pylist(), offsets[:-1], offsets[1:], found):
                out.add(doc_id, data[a:b].tobytes().decode(), best, table)
                if out.size >= OUTPUT:
                    yield out.batch()
                    out = Segmentations()
            if out.rows:
                yield out.batch()

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


class Segmentations:
    """Rows of a result batch."""

    def __init__(self):
        self.rows, self.ids, self.size = [], [], 0

    def add(self, doc_id, text: str, best, table: PieceTable) -> None:
        decoded = [table.decode(ids.tolist()) for _, ids in best]
        own = [np.ascontiguousarray(ids, "<u4") for _, ids in best]
        self.rows.append((doc_id, len(text), len(best), [s for s, _ in best], [len(i) for i in own],
                          [zlib.crc32(i.tobytes()) for i in own], decoded, [d == text for d in decoded]))
        self.ids += own
        self.size += len(text)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_())]
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        each = pa.ListArray.from_arrays(ends([len(i) for i in self.ids]),
                                        pa.array(np.concatenate(self.ids).astype(np.int32)))
        columns.insert(6, pa.ListArray.from_arrays(ends([r[2] for r in self.rows]), each))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])
