"""Operator 7: secret scans; a random forest removes false positives.

Candidates are runs of 12 or more characters of keys and hashes that aren't plain words, and, at any length and of any characters, the
values that follow a secret word and = or : or stand in a URL's credentials. The forest reads each candidate's length,
character classes and transitions, dictionary coverage, the path (or source) and the neighbouring words (in the 60 characters before it and
eight behind). A value without quotes ends at a blank or where the next secret word with a value begins. The forest is trained from labelled
findings: pass your own, or use ``labelled_findings``, which writes them by rule from a seed.

Texts are scanned whole; a longer run is one candidate. Candidates may overlap: a value and a run inside it are both judged. Null and
empty texts have no candidate; a null path has no words. Repeated rows each give their findings; doc_id may be null and of any type. Extra columns stay in ``redact`` and are not read in ``scan_secrets``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.llm.common import bound_batches, give_back

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}")
#: Words of a secret's neighbourhood, of other long values, of test files, and a small dictionary.
SECRET_WORDS = frozenset("api apikey auth authorization aws bearer client_secret credential credentials key passphrase passwd password private pwd secret token".split())
OTHER_WORDS = frozenset("build checksum commit digest etag example hash id image integrity md5 order rev revision sha sha1 sha256 trace uuid version".split())
TEST_WORDS = frozenset("doc docs example examples fixture fixtures lock mock sample samples test tests vendor".split())
DICTIONARY = frozenset(
    "access action address admin app application array auth background base between build button case change class client code color common component config connect container content context control count create "
    "current custom data database default delete description document domain element enable entry error event example field file filter find folder form format function general global group handler header height "
    "hidden image index info input instance interface item key label language large layout length level library license line link list load local locale location login long main manager map margin master match "
    "media member menu message method model module name network next node null number object option order output package page parent password path pattern permission placeholder please position process "
    "project property provider public query random range read record region register release remote remove replace report request require reset resource response result return role root route sample schema script search "
    "select send server service session setting simple size source start state static status storage string style submit super support system table target template test text this time title token tool type update upload "
    "user value variable vector version view visible warning width window with word work write your".split()
)
TRAINED_ON = 3000
_WORDS = "|".join(sorted(SECRET_WORDS - {"api", "aws"}, key=len, reverse=True))
#: A secret word (also the last part of a longer name) and its value in quotes, or the first character of one without; and a URL's credentials.
ASSIGNED = re.compile(rf"(?:(?<![A-Za-z])(?i:{_WORDS})|(?<=[a-z])(?:Key|Token|Secret|Password|Passwd|Passphrase|Pwd))[\"'`\])]{{0,2}}[ \t]{{0,8}}(?::=|=>|==?|:)[ \t]{{0,8}}(?:(?i:bearer|basic)[ \t]+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]*([^\s\"'`]))")
BLANK = re.compile(r"\s")
IN_URL = re.compile(r"://[^\s:/@\"'<>]*:([^\s/\"'<>]+)@")
PASS_WORDS = frozenset("passphrase passwd password pwd secret".split())
#: What stands where a secret would.
PLACEHOLDERS = frozenset("changeme default dummy empty example false hidden int masked nil none null optional redacted required sample str string test todo true undefined unknown unset xxx your".split())
STANDS_FOR = re.compile(r"[$%]?[{(<\[].*|\$\w+|%\w{1,2}|([*.x\-#•])\1*|(?:os|process|self|config|settings|env)\.\S*|\w+\(.*", re.I | re.S)


def classes(s: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in s)


def covered(s: str) -> float:
    """Share of the letters inside dictionary words of four or more letters, longest first."""
    low, i, n = s.lower(), 0, 0
    while i < len(low):
        k = next((k for k in range(min(12, len(low) - i), 3, -1) if low[i : i + k] in DICTIONARY), 0)
        n += k
        i += k or 1
    return n / max(1, len(s))


def describe(candidate: str, before: str, after: str, path: str | None) -> list[float]:
    """The forest's features."""
    kinds = classes(candidate)
    n = len(candidate)
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    count = Counter(candidate)
    entropy = -sum(v / n * math.log2(v / n) for v in count.values())
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    words = [w.lower() for w in re.findall(r"[A-Za-z_]+[0-9]*", before)]
    near = words[-3:]
    vowels = sum(c in "aeiouAEIOU" for c in candidate) / n
    parts = set(re.findall(r"[a-z]+", (path or "").lower()))
    tail = before.rstrip(" \"'`")
    last = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", before)[-1:]
    low = candidate.lower()
    consonants = max(map(len, re.findall(r"[bcdfghjklmnpqrstvwxz]+", low)), default=0)
    return [
        n, turns / max(1, n - 1), entropy, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n,
        (pairs["d", "l"] + pairs["l", "d"]) / n, (pairs["u", "l"] + pairs["l", "u"]) / n, (pairs["u", "d"] + pairs["d", "u"]) / n,
        float(set(candidate.lower()) <= set("0123456789abcdef")), covered(candidate), vowels,
        float(bool(SECRET_WORDS & set(near))), float(bool(OTHER_WORDS & set(near))), float(bool(near) and near[-1] in SECRET_WORDS),
        float(tail[-1:] in ("=", ":")), float(before[-1:] in "\"'`" and before != ""), float(bool(TEST_WORDS & parts)),
        float(candidate[:4] in ("AKIA", "ASIA") or candidate[:4] in ("ghp_", "xoxb", "glpa")), float(n in (32, 40, 64)), float(after[:1] in ("@", ".", "/")),
        float(bool(last) and last[0].lower() in SECRET_WORDS), float(bool(last) and last[0].lower() in PASS_WORDS), float(low.strip("_-.") in PLACEHOLDERS or low in DICTIONARY), float(STANDS_FOR.fullmatch(candidate) is not None),
        float("://" in before[-40:] and before[-1:] == ":" and after[:1] == "@"), float(" " in candidate), consonants,
    ]


def candidates(text: str | None, path: str | None) -> list[tuple[int, int, list[float]]]:
    text, spans = text or "", set()
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if s.isalpha() and (s.islower() or s[1:].islower() or (s.isupper() and len(s) < 20)):
            continue  # a plain word
        spans.add(m.span())
    at, m, blanks = 0, ASSIGNED.search(text), None
    while m:
        begin, end = m.span(m.lastindex)
        bare, at = m.lastindex == 4, begin  # what stands in a value may be a secret word with its own value
        m = ASSIGNED.search(text, at)
        if bare:  # up to a blank, or to the next such word
            if blanks is None:
                blanks = [b.start() for b in BLANK.finditer(text)]
            k = bisect_left(blanks, begin)
            end = min(blanks[k] if k < len(blanks) else len(text), m.start() if m else len(text))
            if more := re.search(r"&(?=\w+=)|[\"'`](?=[,;)\]}>]|$)", text[begin:end]):
                end = begin + more.start()
            end = begin + (len(text[begin:end].rstrip(".,;)]}>")) or end - begin)
        if end > begin:
            spans.add((begin, end))
    spans.update(m.span(1) for m in IN_URL.finditer(text))
    return [(b, e, describe(text[b:e], text[max(0, b - 60) : b], text[e : e + 8], path)) for b, e in sorted(spans)]


def labelled_findings(n: int = TRAINED_ON, seed: int = 23) -> list[tuple[str, str, str, str | None, int]]:
    """(candidate, before, after, path, label) by rule: keys where keys stand, and the usual false alarms."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    run = lambda k, chars: "".join(pick(chars) for _ in range(k))
    hexa, up, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = ["the text of the", "and here is", "for that we have", "from one to the other", "der die und", "le la et un", "write to a@mail6.example.com", "by order and id"]
    words = sorted(DICTIONARY)
    out = []
    for k in range(n):
        lead, path = f"{pick(prose)} ", pick([None, "src1", "src7", "app/main.py", "config/prod.yaml"])
        kind, quote, marks = k % 20, pick(["\"", "'", ""]), "!#$%&*@+-_.^?"
        named = f"{lead}{pick(['password', 'passwd', 'pwd', 'secret', 'token', 'api_key', 'key', 'auth'])}{pick(['=', ': ', ' = '])}{quote}"
        if kind == 0:
            row = (run(int(pick([40, 32, 64])), hexa), f"{lead}{pick(['token', 'secret', 'api_key', 'auth', 'key'])}{pick([' = ', '=', ': '])}{pick(['\"', ''])}", "\"", path, 1)
        elif kind == 1:
            row = ("AKIA" + run(16, up), lead + pick(["", "key ", "aws "]), " ", path, 1)
        elif kind == 2:
            row = (run(int(rng.integers(14, 28)), hexa), f"{lead}{pick(['password', 'passwd', 'pwd', 'secret'])}{pick(['=', ': ', ' = '])}", " ", path, 1)
        elif kind == 3:
            row = (pick(["ghp_", "xoxb-", "sk_live_", ""]) + run(int(rng.integers(24, 44)), alnum), f"{lead}{pick(['token', 'key', 'bearer', 'authorization'])}{pick([' ', '=', ': '])}", " ", path, 1)
        elif kind == 4:
            row = (run(40, hexa), f"{lead}{pick(['commit', 'rev', 'sha1', 'revision'])}{pick([' ', ': ', '='])}", " ", path, 0)
        elif kind == 5:
            row = (run(int(pick([32, 64])), hexa), f"{lead}{pick(['md5', 'sha256', 'checksum', 'digest', 'etag'])}{pick([' ', ': ', '='])}", " ", path, 0)
        elif kind == 6:
            row = (run(int(rng.integers(12, 20)), "0123456789"), lead + pick(["", "order ", "id ", "call ", "key "]), " ", path, 0)
        elif kind == 7:
            row = (pick(["-", "_"]).join(pick(words) for _ in range(int(rng.integers(2, 5)))).ljust(12, "s"), lead + pick(["", "password ", "token = "]), " ", path, 0)
        elif kind == 8:
            row = ("".join(pick(words).title() for _ in range(int(rng.integers(2, 5)))).ljust(12, "s"), lead + pick(["", "key: ", "class "]), "(", path, 0)
        elif kind == 9:
            row = (f"{run(8, hexa)}-{run(4, hexa)}-{run(4, hexa)}-{run(4, hexa)}-{run(12, hexa)}", lead + pick(["", "id ", "uuid: ", "trace "]), " ", path, 0)
        elif kind == 10:
            row = (run(int(pick([20, 32, 40])), hexa), f"{pick(['password', 'token', 'secret'])} = \"", "\"", f"{pick(['tests', 'docs', 'fixtures'])}/{pick(words)}.py", 0)
        elif kind == 11:
            row = (pick(["x" * 16, "0" * 20, "your_token_here", "aaaa-bbbb-cccc", "changeme_changeme", "http//www/index", "2024-01-02_10-20"]) + run(int(rng.integers(0, 3)), "0123456789"), f"{lead}{pick(['token', 'password', 'key', ''])} = ", " ", path, 0)
        elif kind == 14:
            row = (run(int(rng.integers(4, 16)), alnum + "!#$%&*@+-_."), f"{lead}{pick(['https', 'postgres', 'ftp', 'amqp'])}://{pick(['user', 'admin', 'root', pick(words)])}:", f"@{pick(words)}", path, 1)
        elif kind == 15:
            row = (pick([pick(words), pick(words).title(), pick(sorted(PLACEHOLDERS))]), named, quote, path, 0)
        elif kind == 16:
            row = (pick(["${%s}", "{{%s}}", "<%s>", "$%s", "os.environ[%s]", "get_%s()", "{%s}", "[%s]"]) % pick([str.lower, str.upper])(pick(words)) if rng.integers(3) else pick("*x.-") * int(rng.integers(3, 12)), named, quote, path, 0)
        elif kind == 18:
            row = ("".join(pick(["er", "en", "the", "in", "de", "la", "re", "on", "is", "ou", "men", "to", "al", "que"]) for _ in range(int(rng.integers(1, 5)))), f"{lead}{pick(['key', 'token', 'auth', 'private', 'credentials', 'secret'])}: ", " ", path, 0)
        elif kind == 19:
            row = (" ".join(pick(words) for _ in range(int(rng.integers(2, 6)))), named, quote, path, 0)
        else:
            name = f"{lead}{pick(['password', 'passwd', 'pwd', 'secret', 'db_password', 'passphrase', 'token', 'api_key'])}{pick(['=', ': ', ' = ', ':'])}"
            value = run(int(rng.integers(5, 17)), alnum) + pick(marks) + run(int(rng.integers(0, 5)), alnum + marks)
            if kind == 13:
                value = run(int(rng.integers(10, 22)), "abcdefghijklmnopqrstuvwxyz")
            elif kind == 17:
                value = "".join({"o": "0", "a": "4", "e": "3", "i": "1"}.get(c, c) if rng.integers(2) else c for c in pick(words).title()) + pick([*marks, ""]) + run(int(rng.integers(1, 4)), "0123456789")
            row = (value, name + quote, quote, path, 1)
        out.append(row)
    return out


class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left, right, share of label 1."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 25, depth: int = 9, least: int = 3, seed: int = 29) -> Forest:
        rng, trees = np.random.default_rng(seed), []
        for _ in range(n_trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, left: int, nodes=nodes) -> int:
                at, share = len(nodes), float(y[rows].mean())
                nodes.append([-1, 0.0, -1, -1, share])
                if left and len(rows) >= 2 * least and 0 < share < 1:
                    best = (1e-9, -1, 0.0)
                    for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
                        order = np.argsort(x[rows, f], kind="stable")
                        v, lab = x[rows, f][order], y[rows][order]
                        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                        cut = cut[(cut >= least) & (cut <= len(rows) - least)]
                        if len(cut):
                            ones, n = np.cumsum(lab)[cut - 1], len(rows)
                            gini = lambda k, m: 2 * k * (m - k) / m
                            gain = gini(lab.sum(), n) - gini(ones, cut) - gini(lab.sum() - ones, n - cut)
                            k = int(np.argmax(gain))
                            if gain[k] > best[0]:
                                best = (float(gain[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
                    if best[1] >= 0:
                        go = x[rows, best[1]] <= best[2]
                        nodes[at][0], nodes[at][1] = best[1], best[2]
                        nodes[at][2], nodes[at][3] = grow(rows[go], left - 1), grow(rows[~go], left - 1)
                return at

            grow(rows, depth)
            a = np.array(nodes)
            trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str | None, int]] | None = None) -> Forest:
    rows = findings or labelled_findings()
    return Forest.fit(np.array([describe(*r[:4]) for r in rows], float), np.array([r[4] for r in rows], float))


def _scored(texts, paths, forest: Forest) -> list[list[tuple[int, int, float]]]:
    found = [candidates(t, p) for t, p in zip(texts, paths, strict=True)]
    flat = [f for one in found for _, _, f in one]
    scores = iter(forest.predict(np.array(flat, float)).tolist() if flat else [])
    return [[(b, e, next(scores)) for b, e, _ in one] for one in found]


def scan_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """doc_id, begin, end (characters), score, secret (score >= threshold) for every candidate."""
    bound_batches(docs.sparkSession)
    model = forest or train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, own in enumerate(_scored(batch.column("text").to_pylist(), batch.column("path").to_pylist(), model)) for f in own]
            own, *found = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), *(pa.array(v, k) for v, k in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "begin", "end", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.col(path).cast("string").alias("path")).mapInArrow(scan, f"doc_id {kind}, begin long, end long, score double")
    return found.withColumn("secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of text replaced by mark."""
    bound_batches(docs.sparkSession)
    model = forest or train()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, paths = part.column("text").to_pylist(), [None if x is None else str(x) for x in part.column(path).to_pylist()]
                for row, own in enumerate(_scored(texts, paths, model)):
                    spans: list[list[int]] = []
                    for begin, end, score in own:
                        if score >= threshold:
                            if spans and begin < spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], end)
                            else:
                                spans.append([begin, end])
                    if spans:
                        ends = [0, *(end for _, end in spans)]
                        texts[row] = mark.join(texts[row][a:b] for a, b in zip(ends, [*(begin for begin, _ in spans), len(texts[row])], strict=True))
                k = part.schema.get_field_index("text")
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))
            give_back()

    return docs.mapInArrow(clean, docs.schema)
