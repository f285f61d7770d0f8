"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled, lazily and exactly, into a deterministic transducer. After a prefix of a
text, all that matters to what follows is, for each place at which a piece may still be open, the piece's
node in the vocabulary's trie, the last token before it and the count so far less the count now. That tuple
is a state; a character leads to the next state and emits the change in the number of tokens. A sequence of
pieces is an encoding if and only if each two neighbours encode to themselves, so a state is found by
checking pairs, and each pair is checked once by merging.

Characters that no piece contains, and a word-start mark after another character when no piece has one
there, set the state back. Between two such places the transducer always starts from the same states, so
what it emits for such a unit is kept in a table.

A long text is cut into chunks, each with a state map: from the state at its start to the state at its end and the
tokens emitted between. A map holds the run from the text's first state and the states of its first characters; from
another state, the transducer runs on until it meets the run's state at the same place, soon as a rule, and takes the
rest from there. Maps compose associatively, two by two in a logarithmic number of rounds: the upward half of a
parallel prefix scan, as the whole alone is asked for. Work and memory are linear in a text, with or without spaces.

Defined cases: null text is empty; an empty text has no tokens; repeated rows are counted each on their own; very
long texts are counted whole, within one task; an empty table gives no rows; columns other than doc_id and text are
ignored, whatever their names. A model that is not a BPE one without normalisation is refused with a ValueError.
"""

from __future__ import annotations

import gc
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm.common import small_batches, table, trimmed

LIMIT = 4096
#: Characters of a chunk; bounds of the tables that one Python worker keeps, which are emptied when full.
CHUNK, MAX_UNITS, MAX_STATES, MAX_PAIRS = 1 << 16, 350_000, 150_000, 250_000
#: First characters of a chunk at which its map knows the states.
TRACE = 256
SPACE = "▁"
START, BYTES = -1, -2  # "last tokens" that merge with nothing


class Transducer:
    def __init__(self, pieces: list[str], scores: list[float], alone: set[int]):
        """pieces by id; a higher score merges earlier; alone: ids that text never becomes (controls and bytes)."""
        self.score = {p: s for i, (p, s) in enumerate(zip(pieces, scores)) if i not in alone}
        self.text: list[str] = sorted(self.score)
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        self.halves: dict[str, list[str]] = {}  # what the last joining of a piece joined
        self.pairs: dict[tuple[int, int], bool] = {}
        inner_mark = any(SPACE in p.lstrip(SPACE) for p in self.score)
        if inner_mark:
            raise ValueError("pieces with a word-start mark inside aren't supported")
        self.known = {c for p in self.score for c in p}
        for i, p in enumerate(self.text):
            if len(p) > 1:
                steps = self.merge(p)
                if steps[-1] != [p]:
                    continue  # never the encoding of its own text, so never emitted
                self.halves[p] = steps[-2]
            at = 0
            for c in p:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                at = self.trie[at][c]
            self.token[at] = i
        self.states: dict[tuple, dict] = {}

    def merge(self, text: str) -> list[list[str]]:
        """The parts after each joining, by definition: join the best-scored neighbours, leftmost first, while any can be joined."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            steps.append(parts)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return [*steps, parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are.

        Going back through the joinings that made them, a and b are what stood at the border at some time. A
        border is joined when a + b is a piece that came up before the joining that used up a or b. Of equal
        pieces the leftmost is joined first.
        """
        if left < 0:
            return True
        key = (left, right)
        got = self.pairs.get(key)
        if got is not None:
            return got
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        a, b, score, halves = self.text[left], self.text[right], self.score, self.halves
        used, by_right, got = None, False, True
        while True:
            s = score.get(a + b)
            if s is not None and (used is None or s > used or (s == used and by_right)):
                got = False
                break
            x, y = halves.get(a), halves.get(b)
            if x is None and y is None:
                break
            if y is None or (x is not None and score[a] < score[b]):  # a was made last
                used, by_right, a = score[a], False, x[1]
            else:
                used, by_right, b = score[b], True, y[0]
        self.pairs[key] = got
        return got

    def state(self, key: tuple) -> dict:
        """A state is the table of the transitions found so far; it knows its own key."""
        got = self.states.get(key)
        if got is None:
            if len(self.states) >= MAX_STATES:
                for s in self.states.values():  # states refer to each other in cycles
                    s.clear()
                self.states.clear()
            got = self.states[key] = {"": key}
        return got

    def step(self, state: dict, c: str) -> tuple[dict, int]:
        """The next state, and the tokens emitted: how many more than before the text read so far has."""
        if c not in self.known:
            out = (self.state(((0, BYTES, 0),)), len(c.encode("utf-8", "surrogatepass")))
        else:
            moved, last, count = [], None, 0
            for node, before, less in state[""]:
                to = self.trie[node].get(c)
                if to is not None:
                    t = self.token[to]
                    if last is None and t >= 0 and self.fits(before, t):
                        last, count = t, less + 1
                    if self.trie[to]:
                        moved.append((to, before, less))
            if last is None:
                raise ValueError(f"no piece ends at {c!r}")
            out = (self.state((*((n, b, less - count) for n, b, less in moved), (0, last, 0))), count)
        state[c] = out
        return out

    def count(self, unit: str) -> int:
        state, total = self.state(FIRST), 0
        for c in unit:
            state, emitted = state.get(c) or self.step(state, c)
            total += emitted
        return total


FIRST = ((0, START, 0),)


class ChunkMap:
    """State at the start to state at the end and tokens between, of a chunk."""

    def __init__(self, machine: Transducer, text: str):
        self.machine, self.text, self.trace = machine, text, []
        state, total = machine.state(FIRST), 0
        for i, c in enumerate(text):
            state, emitted = state.get(c) or machine.step(state, c)
            total += emitted
            if i < TRACE:
                self.trace.append((state[""], total))
        self.end, self.tokens = state[""], total

    def apply(self, key: tuple) -> tuple[tuple, int]:
        if key == FIRST:
            return self.end, self.tokens
        state, total = self.machine.state(key), 0
        for i, c in enumerate(self.text):
            state, emitted = state.get(c) or self.machine.step(state, c)
            total += emitted
            if i < TRACE and state[""] == self.trace[i][0]:
                return self.end, total + self.tokens - self.trace[i][1]
        return state[""], total


class JoinedMap:
    """Two maps one after the other."""

    def __init__(self, a: ChunkMap | JoinedMap, b: ChunkMap | JoinedMap):
        self.a, self.b = a, b
        self.end, n = b.apply(a.end)
        self.tokens = a.tokens + n

    def apply(self, key: tuple) -> tuple[tuple, int]:
        at, n = self.a.apply(key)
        if at == self.a.end:  # from here on as in the run from the first state
            return self.end, n + self.tokens - self.a.tokens
        end, m = self.b.apply(at)
        return end, n + m


def composed(maps: list) -> ChunkMap | JoinedMap:
    """Neighbours joined, round by round."""
    while len(maps) > 1:
        maps = [JoinedMap(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter(dict):
    """Tokens of units, kept in two generations."""

    def __init__(self, machine: Transducer):
        self.machine, self.old = machine, {}
        stop = "".join(sorted({chr(i) for i in range(1, 128)} - machine.known))
        stop = re.escape(stop)
        #: A unit: a character no piece holds, or marks and what follows up to the next mark or such a character.
        self.units = re.compile(f"[{stop}]|{SPACE}*[^{SPACE}{stop}]+|{SPACE}+") if stop else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

        #: Between a letter and a mark that follows no letter in any piece nothing is joined, either.
        after = {b for p in machine.score for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = re.escape("".join(sorted(c for c in machine.known - after if not c.isalnum() and c != SPACE)))
        self.cuts = re.compile(rf"(?<=[^\W\d_])(?=[{marks}])") if marks else None

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            parts = self.cuts.split(unit) if self.cuts else [unit]
            n = self.machine.count(unit) if len(parts) < 2 else sum(self[p] for p in parts)
        if len(unit) <= 48:
            if len(self) >= MAX_UNITS:  # two generations: what is still in use comes back from the old one
                self.old = dict(self)
                self.clear()
            self[unit] = n
        return n

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= chunk:
            return sum(map(self.__getitem__, self.units.findall(text)))
        return composed([ChunkMap(self.machine, text[i : i + chunk]) for i in range(0, len(text), chunk)]).tokens


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's compiled transducer for a sentencepiece BPE model without text normalisation."""
    if path not in _COUNTERS:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not kinds <= {1, 2, 3, 6} or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError(f"{path} is not a BPE model without normalisation")
        alone = {i for i, p in enumerate(model.pieces) if p.type != 1}
        _COUNTERS[path] = Counter(Transducer([p.piece for p in model.pieces], [p.score for p in model.pieces], alone))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text. path: the vocabulary file, on every machine; None: the public one."""
    small_batches(docs.sparkSession)

    def run(batches):
        import public_tokenizers

        c = counter(path or public_tokenizers.path("piece_bpe_32k.model"))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            gc.disable()  # else it walks all states again and again
            n = [c.tokens(t) for t in texts]
            gc.enable()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op3_token_counts": op3_token_counts}, {}
