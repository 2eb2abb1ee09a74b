"""Line dedup by a log-template tree of fixed depth.

A line's tokens with digits are variable fields. The tree's first level is the number of tokens, the next ones are the
DEPTH leading tokens; a leaf holds templates of equally many tokens. Besides the line as it stands, a leaf's templates
generalise further tokens to fields, at most the share that the similarity leaves open:

* any run of so many tokens, wherever it lies (so one field, or several that are near each other, whatever their words);
* all tokens that are rare at their place in the leaf (so any number of fields whose words change).

A template that recurs in enough documents is dropped from all but the first document that has it. Which templates a line
has does not depend on the order of lines or on their number, so a leaf of any size is counted in pieces: what is shuffled
are hashes, combined before the shuffle, and no task ever holds a leaf.

A line is the exclusive or of the hashes of its (place, token) pairs, so a template is had by exchanging some of these for
the fields', and all lines of a batch are treated at once in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fits, session, text_of, written
from .files import release
from .hashes import BASE, mixed, powers
from .tokens import chunks

#: Leading tokens on a path.
DEPTH = 3
#: Share of equal tokens that joins a line to a template, and documents that make a template recur.
SIMILARITY, LEAST_DOCS = 0.75, 10
#: Lines of so many tokens are passages, which recur in so many documents already.
LONG, LONG_LEAST_DOCS = 50, 2
#: Characters that are treated at once.
CHARS = 300_000
#: Rows of a table of one to four longs that workers may hold.
MOST = 1_000_000
FIELD = np.uint64(0x2545F4914F6CDD1D)
_PLACE, _COUNT, _TOKEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

ROW = "doc_id long, th long, leaf long, template long, n_tokens int"
KEY = "kind int, key long, doc_id long, th long, n_tokens int, low long, high long"
WIDE = "doc_id long, th long, leaf long, template long, n_tokens int, tokens binary"


def open_tokens(n_tokens: np.ndarray, similarity: float) -> np.ndarray:
    """How many tokens of a line may differ from its template's."""
    return np.floor(n_tokens * (1 - similarity) + 1e-9).astype(np.int64)


def _at(place: np.ndarray, token) -> np.ndarray:
    return mixed(token ^ (place.astype(np.uint64) + np.uint64(1)) * _PLACE)


class Lines:
    """The lines with tokens of some texts: doc and number of each line, and its tokens from start on.

    tokens: a hash of each token at its place; template and leaf: a hash of each line's."""

    def __init__(self, tokens: np.ndarray, n_tokens: np.ndarray):
        self.tokens, self.n = tokens, n_tokens
        self.start = np.cumsum(n_tokens) - n_tokens
        self.place = np.arange(len(tokens)) - np.repeat(self.start, n_tokens)
        self.prefix = np.zeros(len(tokens) + 1, np.uint64)
        np.bitwise_xor.accumulate(tokens, out=self.prefix[1:])
        self.count = mixed(n_tokens.astype(np.uint64) * _COUNT)
        self.line = self.prefix[self.start + n_tokens] ^ self.prefix[self.start] ^ self.count
        self.template = mixed(self.line).view(np.int64)
        self.leaf = mixed(self.prefix[self.start + np.minimum(n_tokens, DEPTH)] ^ self.prefix[self.start] ^ self.count ^ _TOKEN).view(np.int64)

    @classmethod
    def of(cls, texts: list[str]) -> Lines:
        rows, doc, number = [], [], []
        for d, text in enumerate(texts):
            for k, line in enumerate(text.split("\n")):
                words = line.split()
                if words:
                    rows.append(" ".join(words))
                    doc.append(d)
                    number.append(k)
        if rows:
            raw = np.frombuffer(("\n".join(rows) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
            ends = np.flatnonzero((raw == 32) | (raw == 10))
            starts = np.concatenate([[0], ends[:-1] + 1])
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64, out=total[1:])
            words = mixed((total[ends] - total[starts]) * powers(pow(BASE, -1, 1 << 64), len(raw))[starts] + (ends - starts).astype(np.uint64))
            digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
            words[digits[ends] > digits[starts]] = FIELD
            n = np.diff(np.concatenate([[-1], np.flatnonzero(raw[ends] == 10)]))
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            out = cls(_at(place, words), n)
        else:
            out = cls(np.empty(0, np.uint64), np.empty(0, np.int64))
        out.doc, out.number = np.array(doc, np.int64), np.array(number, np.int64)
        return out

    def runs(self, use: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """(line, template) with a run of open tokens as fields, for each place behind the leading tokens; lines by index."""
        n, wide = self.n[use], open_tokens(self.n[use], similarity)
        times = np.where(wide > 0, np.maximum(n - DEPTH - wide + 1, 0), 0)
        line, wide = np.repeat(use, times), np.repeat(wide, times)
        at = DEPTH + np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
        fields = np.zeros(int(n.max(initial=0)) + 2, np.uint64)
        np.bitwise_xor.accumulate(_at(np.arange(len(fields) - 1), FIELD), out=fields[1:])
        first = self.start[line] + at
        out = self.line[line] ^ self.prefix[first + wide] ^ self.prefix[first] ^ fields[at + wide] ^ fields[at]
        return line, mixed(out).view(np.int64)

    def places(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, token, key) of all tokens behind the leading ones that are no fields yet: key is the token in its leaf."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        wanted = np.zeros(len(self.n), bool)
        wanted[use] = True
        token = np.flatnonzero(wanted[line] & (self.place >= DEPTH) & (self.tokens != _at(self.place, FIELD)))
        key = mixed(self.tokens[token] * _TOKEN ^ self.leaf[line[token]].view(np.uint64)).view(np.int64)
        return line[token], token, key

    def rare(self, use: np.ndarray, similarity: float, is_frequent) -> tuple[np.ndarray, np.ndarray]:
        """(line, template) with all rare tokens as fields, for lines in which these are few enough."""
        line, token, key = self.places(use)
        odd = ~is_frequent(key)
        line, token = line[odd], token[odd]
        times = np.bincount(line, minlength=len(self.n))
        change = np.zeros(len(self.n), np.uint64)
        np.bitwise_xor.at(change, line, self.tokens[token] ^ _at(self.place[token], FIELD))
        few = np.flatnonzero((times > 0) & (times <= open_tokens(self.n, similarity)))
        return few, mixed(self.line[few] ^ change[few]).view(np.int64)


class Among:
    """Membership in a set of longs, with a value for each."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are members, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.find(keys)[0]


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """A bounded table's columns on the driver."""
    rows = df.select(*names).toArrow()
    return [rows.column(n).to_numpy(zero_copy_only=False) for n in names]


def _batch(names: list[str], columns: list, types: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _parts(batches):
    """(doc_id, th, rest of the batch, texts) for some texts at a time; th is a hash of the text."""
    release()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in chunks(texts, CHARS):
            part = batch.slice(lo, hi - lo)
            yield part, texts[lo:hi]


def _once(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions of one of each (document, keys)."""
    order = np.lexsort((*reversed(keys), doc))
    same = doc[order][1:] == doc[order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    return order[np.concatenate([[True], ~same])] if len(order) else order


def _rows(batches):
    """The distinct lines of each document."""
    import pyarrow as pa

    for part, texts in _parts(batches):
        lines = Lines.of(texts)
        one = _once(lines.doc, lines.template)
        doc = pa.array(lines.doc[one])
        yield _batch(["doc_id", "th", "leaf", "template", "n_tokens"], [part.column(0).take(doc), part.column(1).take(doc), lines.leaf[one], lines.template[one], lines.n[one]], [None, None, pa.int64(), pa.int64(), pa.int32()])


def _wide(batches):
    """The distinct lines of each document with their tokens."""
    import pyarrow as pa

    for part, texts in _parts(batches):
        lines = Lines.of(texts)
        one = _once(lines.doc, lines.template)
        doc = pa.array(lines.doc[one])
        raw = [lines.tokens[a : a + n].tobytes() for a, n in zip(lines.start[one].tolist(), lines.n[one].tolist())]
        yield _batch(["doc_id", "th", "leaf", "template", "n_tokens", "tokens"], [part.column(0).take(doc), part.column(1).take(doc), lines.leaf[one], lines.template[one], lines.n[one], raw], [None, None, pa.int64(), pa.int64(), pa.int32(), pa.binary()])


def _generalised(lines: Lines, use: np.ndarray, similarity: float, frequent: Among | None):
    """(kind, line, key): templates (0), and as long as the frequent tokens are not known the tokens to count (1)."""
    if frequent is None:
        a, x = lines.runs(use, similarity)
        b, _, y = lines.places(use)
        return np.concatenate([np.zeros(len(a), np.int32), np.ones(len(b), np.int32)]), np.concatenate([a, b]), np.concatenate([x, y])
    line, key = lines.rare(use, similarity, frequent)
    return np.zeros(len(line), np.int32), line, key


def _keys(batches, leaves: Among, similarity: float, frequent: Among | None):
    """The generalised templates of lines in some leaves, once a document, with the least and largest line that has each."""
    import pyarrow as pa

    for part, texts in _parts(batches):
        lines = Lines.of(texts)
        kind, line, key = _generalised(lines, np.flatnonzero(leaves(lines.leaf)), similarity, frequent)
        doc, template = lines.doc[line], lines.template[line]
        order = np.lexsort((template, key, kind, doc))
        doc, kind, key, template, line = doc[order], kind[order], key[order], template[order], line[order]
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
        last = np.append(new[1:], True)[: len(new)]
        at = pa.array(doc[new])
        yield _batch(["kind", "key", "doc_id", "th", "n_tokens", "low", "high"], [kind[new], key[new], part.column(0).take(at), part.column(1).take(at), lines.n[line[new]], template[new], template[last]], [pa.int32(), pa.int64(), None, None, pa.int32(), pa.int64(), pa.int64()])


def _keys_of_rows(batches, similarity: float):
    """The same for rows of _wide: runs and tokens, and each row's line and tokens for a join with the frequent ones."""
    import pyarrow as pa

    for batch in batches:
        n = batch.column(4).to_numpy().astype(np.int64)
        lines = Lines(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64), n)
        a, x = lines.runs(np.arange(len(n)), similarity)
        b, token, y = lines.places(np.arange(len(n)))
        change = (lines.tokens[token] ^ _at(lines.place[token], FIELD)).view(np.int64)
        line, at = np.concatenate([a, b]), pa.array(np.concatenate([a, b]))
        for lo in range(0, len(line), 50_000):
            s = slice(lo, lo + 50_000)
            yield _batch(
                ["kind", "key", "doc_id", "th", "n_tokens", "template", "line", "change", "open"],
                [np.concatenate([np.zeros(len(a), np.int32), np.ones(len(b), np.int32)])[s], np.concatenate([x, y])[s], batch.column(0).take(at[s]), batch.column(1).take(at[s]), lines.n[line[s]], lines.template[line[s]],
                 lines.line.view(np.int64)[line[s]], np.concatenate([np.zeros(len(a), np.int64), change])[s], open_tokens(lines.n, similarity)[line[s]]],
                [pa.int32(), pa.int64(), None, None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])


WIDE_KEY = "kind int, key long, doc_id long, th long, n_tokens int, template long, line long, change long, open long"


def _mixed_lines(batches):
    """Templates from lines with rare tokens exchanged."""
    import pyarrow as pa

    for batch in batches:
        key = mixed(batch.column(4).to_numpy().view(np.uint64)).view(np.int64)
        yield _batch(["doc_id", "th", "n_tokens", "template", "key"], [*(batch.column(k) for k in range(4)), key], [None, None, None, None, pa.int64()])


def _strip(batches, drop: Among | None, leaves: Among | None, similarity: float, frequent: Among | None):
    """Texts without the lines to drop, and their numbers. Without ``drop`` the fourth column has the templates to drop."""
    import pyarrow as pa

    for part, texts in _parts(batches):
        lines = Lines.of(texts)
        if drop is None:
            given = [frozenset(g) for g in part.column(3).to_pylist()]
            gone = np.array([t in given[d] for t, d in zip(lines.template.tolist(), lines.doc.tolist())], bool)
        else:
            use = np.flatnonzero(leaves(lines.leaf))
            found = [(np.arange(len(lines.n)), lines.template), lines.runs(use, similarity), lines.rare(use, similarity, frequent)]
            line, key = (np.concatenate(x) for x in zip(*found))
            known, at = drop.find(key)
            line, at = line[known], at[known]
            ids, hashes = part.column(0).fill_null(0).to_numpy(), part.column(1).to_numpy()
            none = part.column(0).is_null().to_numpy(zero_copy_only=False)
            first_none, first, first_hash = (v[at] for v in drop.values)
            doc = lines.doc[line]
            own = (first_none == none[doc]) & (first == ids[doc]) & (first_hash == hashes[doc])
            gone = np.zeros(len(lines.n), bool)
            gone[line[~own]] = True
        out, n_lines = list(texts), [t.count("\n") + 1 for t in texts]
        times = np.bincount(lines.doc[gone], minlength=len(texts))
        skip: dict[int, set] = {}
        for d, k in zip(lines.doc[gone].tolist(), lines.number[gone].tolist()):
            skip.setdefault(d, set()).add(k)
        for d, numbers in skip.items():
            out[d] = "\n".join([x for k, x in enumerate(texts[d].split("\n")) if k not in numbers])
        yield _batch(["doc_id", "text", "n_lines", "n_dropped", *part.schema.names[4:]], [part.column(0), out, n_lines, times, *part.columns[4:]], [None, pa.string(), pa.int64(), pa.int64(), *[None] * len(part.columns[4:])])


def _first():
    """The first row of a template: by id, missing ones last, then by its text's hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")).alias("first")


class Recurring:
    """What drop_recurring has found: written tables of recurring templates, of leaves whose lines are generalised, and of
    tokens that are frequent at their place."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, similarity: float = SIMILARITY):
        self.docs, self.similarity, self.wide = docs, similarity, None
        least = F.when(F.col("n_tokens") >= LONG, min(int(least_docs), LONG_LEAST_DOCS)).otherwise(int(least_docs))
        count = F.count(F.lit(1)).alias("n")
        kinds, again = ([F.min(a).alias("low"), F.max(b).alias("high")] for a, b in (("template", "template"), ("low", "high")))
        exact = written(docs.mapInArrow(_rows, ROW).groupBy("leaf", "template", "n_tokens").agg(count, _first()), "templates")
        # a leaf of one template, or of lines too short for a field, has nothing to generalise
        many = exact.groupBy("leaf", "n_tokens").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("templates"))
        self.leaves = written(many.where((F.col("n") >= least) & (F.col("templates") > 1)).select("leaf"), "leaves")
        found = [exact.where(F.col("n") >= least).select(F.col("template").alias("key"), "first")]
        # beyond what workers can hold, lines are joined with the leaves and their tokens with the frequent ones
        self.held = fits(self.leaves, MOST)
        if self.held:
            self.among = Among(*_columns(self.leaves, "leaf"))
            keys = docs.mapInArrow(lambda b, leaves=self.among: _keys(b, leaves, similarity, None), KEY)
        else:
            # once a document, as _keys gives them
            keys = self._wide_rows().groupBy("kind", "key", "doc_id", "th", "n_tokens").agg(*kinds)
        # what a single line gives is that line's own template
        several = F.col("low") < F.col("high")
        wanted = F.when(F.col("kind") == 0, (F.col("n") >= least) & several).otherwise(F.col("n") >= int(least_docs))
        often = written(keys.groupBy("kind", "key", "n_tokens").agg(count, _first(), *again).where(wanted), "generalised")
        found.append(often.where("kind = 0").select("key", "first"))
        self.tokens = often.where("kind = 1").select("key")
        self.held = self.held and fits(often, MOST)
        if self.held:
            self.frequent = Among(*_columns(self.tokens, "key"))
            rare = docs.mapInArrow(lambda b, leaves=self.among, frequent=self.frequent: _keys(b, leaves, similarity, frequent), KEY)
        else:
            rare = self._rare_by_join().groupBy("doc_id", "th", "n_tokens", "key").agg(*kinds)
        found.append(rare.groupBy("key", "n_tokens").agg(count, _first(), *again).where((F.col("n") >= least) & several).select("key", "first"))
        self.table = written(found[0].unionByName(found[1]).unionByName(found[2]).groupBy("key").agg(F.min("first").alias("first")).select("key", "first.*"), "recurring")

    def _wide_rows(self) -> DataFrame:
        if self.wide is None:
            similarity = self.similarity
            lines = self.docs.mapInArrow(_wide, WIDE).join(self.leaves, "leaf", "left_semi").select("doc_id", "th", "leaf", "template", "n_tokens", "tokens")
            self.wide = written(lines.mapInArrow(lambda b: _keys_of_rows(b, similarity), WIDE_KEY), "line-keys")
        return self.wide

    def _rare_by_join(self) -> DataFrame:
        places = self._wide_rows().where("kind = 1").join(self.tokens, "key", "left_anti")
        changed = places.groupBy("doc_id", "th", "n_tokens", "template", "line", "open").agg(F.bit_xor("change").alias("change"), F.count(F.lit(1)).alias("n")).where("n <= open")
        return changed.select("doc_id", "th", "n_tokens", "template", F.col("line").bitwiseXOR(F.col("change")).alias("line")).mapInArrow(_mixed_lines, "doc_id long, th long, n_tokens int, template long, key long")

    def stripped(self, docs: DataFrame, schema: str) -> DataFrame:
        similarity = self.similarity
        if self.held and fits(self.table, MOST):
            drop = Among(*_columns(self.table, "key", "none", "id", "th"))
            leaves, frequent = self.among, self.frequent
            return docs.mapInArrow(lambda b: _strip(b, drop, leaves, similarity, frequent), schema)
        lines = self.docs.mapInArrow(_rows, ROW).select("doc_id", "th", "template", F.col("template").alias("key"))
        lines = lines.unionByName(self._wide_rows().where("kind = 0").select("doc_id", "th", "template", "key")).unionByName(self._rare_by_join().select("doc_id", "th", "template", "key"))
        table = self.table.withColumnsRenamed({"th": "first_th"})
        own = (F.col("doc_id").isNull() == F.col("none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("th") == F.col("first_th"))
        gone = lines.join(table, "key").where(~own).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("template").alias("_gone"))
        cols = [c for c in docs.columns if c not in ("doc_id", "th", "text", "_drop")]
        joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (docs["th"] == gone["_th"]), "left").select("doc_id", "th", "text", F.coalesce("_gone", F.array().cast("array<long>")).alias("_drop"), *cols)
        return joined.mapInArrow(lambda b: _strip(b, None, None, similarity, None), schema)


def drop_recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, similarity: float = SIMILARITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped, and the columns named in keep, for every row of docs.

    A line is dropped if one of its templates occurs in at least least_docs rows (LONG_LEAST_DOCS for lines of LONG tokens or
    more), unless its row is the first that has the template (smallest doc_id, missing ones last, then by a hash of the
    text), so one place keeps it. A token is rare at its place if it stands there in fewer than least_docs rows of the leaf.
    Lines without tokens stay. The other lines of a text keep their order and content. Null texts are empty. Rows are known
    by id and text: missing and repeated ids do no harm, a repeated row is treated like its first. An empty table gives none.

    Plan: four scans of the texts; what is shuffled are hashes of templates, combined before the shuffle. Leaves, frequent
    tokens and recurring templates go to the workers if they are few (checked by rows and bytes), else lines are joined with
    them.
    """
    session(docs.sparkSession)
    text = text_of("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), F.array().cast("array<long>").alias("_drop"), *keep)
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return Recurring(docs.select("doc_id", "th", "text"), least_docs, similarity).stripped(docs, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
