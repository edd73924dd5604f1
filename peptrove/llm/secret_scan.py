"""Secret scans: high-recall candidates, and a random forest that removes false positives.

Candidates are values assigned to anything, long runs of key characters, and
private-key blocks.  Each has features of its length, its character
transitions, how much of it dictionary words cover, the path of its document
and the words beside it.  A forest of classification trees, grown in numpy on
labelled findings, gives the probability that a candidate is a secret.

Labelled findings are a parameter, rows of (text, start, end, path, label);
the default ones are written by ``labelled_findings``: keys, tokens, passwords
and private-key blocks as they are pasted, and hashes, identifiers,
placeholders, words and numbers as they are found beside the same words.

Findings never carry the secret itself, but its place, length and a
fingerprint.  Defined cases: null and empty texts have no findings; a null
path is an empty one; very long texts are scanned whole; repeated rows and
repeated secrets are each found; an empty table gives no rows; ``redact``
leaves null texts null and keeps all other columns whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import extended, lean, slices, table, texts_of

ASSIGNED = rb"""(?:=>|:=|[=:])[ \t]{0,4}["'`]?(?:(?i:bearer|basic|token)[ \t]+)?([^\s"'`<>,;(){}\[\]]{6,})"""
RUN = rb"[A-Za-z0-9+/_\-]{16,}+(?:\.[A-Za-z0-9+/_\-]{8,}+)+|[A-Za-z0-9+/_\-]{20,}={0,2}"
CANDIDATE = re.compile(ASSIGNED + b"|" + RUN)
#: a private key to its END mark, or as far as lines of key characters go; line breaks may be escaped, headers may precede the key
BLOCK = re.compile(
    rb"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[A-Za-z0-9+/=\s\\:,.()\"'-])*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\+[nrt])*[A-Za-z0-9+/]{16,}={0,2})*+(?:(?:\s|\\+[nrt])+[A-Za-z0-9+/]{1,15}(?:={1,2}|(?=\s*\Z)))?)"
)
MARKS = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|\\+[nrt]|\s+")
#: a value given to a name inside another value, as in the query of an address or in its user part
INNER = re.compile(rb"[?&;|]?[A-Za-z_][A-Za-z0-9_.\-]{0,63}=([^=&?#|][^&?#|]{5,})|://[^/?#@:]*:([^/?#@]{6,})@")
#: what precedes a value that is meant to be kept secret, or a value that only looks like one
SECRET_WORDS = "password passwd pwd passphrase secret token apikey api access private credential credentials auth authorization bearer key client signing encryption"
PLAIN_WORDS = "sha sha1 sha256 md5 hash digest checksum commit revision rev uuid guid id etag color colour version build integrity fingerprint session request trace order invoice isbn href src url http https link path file image img data title name tel phone"
PLACEHOLDERS = "example sample dummy placeholder changeme change your insert here xxxx test fake none null true false todo undefined redacted secret password token key foo bar value string default enter replace"
COMMON = "the and for with this that from have not you all are was his her one our out day get has him how man new now old see two way who boy did its let put say she too use user name data file path code line text page list item type time date year work home main list node index table model class method function return value object number string error message service server client config local remote public private access session request response"
TEST_PATH = "test tests spec fixture fixtures example examples sample samples mock docs doc demo"
NAMES = (
    "length log_length entropy distinct digit upper lower other hex base64 class_changes letter_transitions longest_letters longest_digits repeats "
    "covered placeholder secret_near plain_near secret_touching assigned quoted known_prefix block uuid_like words_like path_test path_lock digits_only decimal_dots url_like"
).split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "SG.", "npm_", "ya29.")
THRESHOLD = 0.5
TREES, TREE_DEPTH, LEAF = 40, 10, 3

DICTIONARY = sorted({w for ws in (SECRET_WORDS, PLAIN_WORDS, PLACEHOLDERS, COMMON) for w in ws.split() if len(w) >= 3}, key=lambda w: (-len(w), w))
COVER = re.compile("|".join(map(re.escape, DICTIONARY)))
SECRET_SET, PLAIN_SET, TEST_SET = set(SECRET_WORDS.split()), set(PLAIN_WORDS.split()), set(TEST_PATH.split())
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
WORDS = re.compile(r"[a-z0-9]+")
#: how common letter pairs are in words: vowels and consonants alternate
VOWELS = set("aeiouy")


def candidates(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, in order and apart. Blocks go first; the other candidates are sought between them."""
    out, at = [], 0
    for m in BLOCK.finditer(text):
        out += values(text, at, m.start())
        at = m.end()
        out.append((m.start(), at, "block"))
    return out + values(text, at, len(text))


def values(text: bytes, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Assigned values and runs of a part of the text. A value that holds others, such as an address, is given as those."""
    out = []
    for m in CANDIDATE.finditer(text, lo, hi):
        if m[1] is None:
            found = [(m.start(), m.end(), "run")]
        else:
            start, end = m.span(1)
            while end > start and text[end - 1] in b".!?#$%&*" and end - start > 6:
                end -= 1
            found = inside(text, start, end) or [(start, end, "assigned")]
        for start, end, kind in found:
            value = text[start:end]
            if kind == "run" and not (any(48 <= c <= 57 for c in value) and any(c >= 65 for c in value)):
                continue  # words and numbers, not keys
            out.append((start, end, kind))
    return out


def inside(text: bytes, start: int, end: int) -> list[tuple[int, int, str]]:
    """Candidates inside an assigned address or list of assignments: named values, and runs beside them."""
    if not (b"://" in text[start:end] or text.startswith(b"//", start) or b"&" in text[start:end] or b"?" in text[start:end]):
        return []
    named = [(*m.span(m.lastindex), "assigned") for m in INNER.finditer(text, start, end)]
    if not named:
        return []
    out, at = [], start
    for s, e, kind in [*named, (end, end, "")]:
        out += [(*m.span(), "run") for m in re.compile(RUN).finditer(text, at, s)]
        out += [(s, e, kind)] * (e > s)
        at = e
    return out


def split_words(text: str) -> list[str]:
    return WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())


def describe(text: bytes, start: int, end: int, kind: str, path: str) -> list[float]:
    value = text[start:end].decode("utf-8", "replace")
    if kind == "block":  # what stands between the marks
        value = MARKS.sub("", value) or value
    before = text[max(0, start - 48) : start].decode("utf-8", "replace")
    after = text[end : end + 24].decode("utf-8", "replace")
    n = max(1, len(value))
    counts = {c: value.count(c) for c in set(value)}
    digit, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    letters = [(a in VOWELS) != (b in VOWELS) for a, b in zip(value.lower(), value[1:].lower()) if a.isalpha() and b.isalpha()]
    longest = {k: max((len(m) for m in re.findall(f"{k}+", "".join("l" if x in "ul" else x for x in kinds))), default=0) for k in "ld"}
    low = value.lower()
    cover = sum(len(m) for m in COVER.findall(low))
    near, side = split_words(before), split_words(after)
    last = near[-3:]
    hexa = sum(c in string.hexdigits for c in value) / n
    parts = WORDS.findall(path.lower())
    return [
        float(n), math.log(n), -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n, digit / n, upper / n, lower / n, (n - digit - upper - lower) / n,
        hexa, sum(c.isalnum() or c in "+/=_-" for c in value) / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(letters) / max(1, len(letters)) if letters else 0.5,
        longest["l"] / n, longest["d"] / n, sum(a == b for a, b in zip(value, value[1:])) / n, cover / n,
        float(any(w in low for w in ("example", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "test", "fake", "redacted", "todo", "here"))),
        float(sum(w in SECRET_SET for w in near)), float(sum(w in PLAIN_SET for w in near + side[:2])), float(any(w in SECRET_SET for w in last[-2:])),
        float(kind == "assigned"), float(before[-1:] in "\"'`" and before != ""), float(value.startswith(PREFIXES)), float(kind == "block"), float(bool(UUID.fullmatch(value))),
        float(bool(re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+)*", value))), float(any(w in TEST_SET for w in parts)), float("lock" in parts or "sum" in parts),
        float(value.isdigit()), value.count(".") / n, float("://" in value or value.startswith(("/", "//", "www."))),
    ]


class Forest:
    """Classification trees on bootstrap samples, each split over a random subset of features."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at]), at)
            out += value[at]
        return out / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        p = y[rows].mean()
        nodes.append([-1, 0.0, me, me, p])
        if d == 0 or len(rows) < 2 * leaf or p in (0.0, 1.0):
            return me
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order) + 1)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= leaf) & (n[-1] - n[:-1] >= leaf))
            if len(ok):
                a, b = ones[ok] / n[ok], (ones[-1] - ones[ok]) / (n[-1] - n[ok])
                impurity = a * (1 - a) * n[ok] + b * (1 - b) * (n[-1] - n[ok])
                k = int(impurity.argmin())
                if impurity[k] < best[0]:
                    best = (impurity[k], int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = add(rows[goes], d - 1)
            nodes[me][3] = add(rows[~goes], d - 1)
        return me

    add(rng.integers(0, len(x), len(x)), depth)
    f, c, left, right, value = map(np.array, zip(*nodes, strict=True))
    return f.astype(np.int64), c.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, leaf: int = LEAF, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    return Forest([grow(x, y.astype(float), rng, depth, leaf) for _ in range(trees)])


def labelled_findings(n: int, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label): made-up findings in made-up prose, half of them secrets."""
    rng = random.Random(seed)
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "ba re ti on la mu ske dor vi en sa lo pri tem un the of and er in".split()
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    pick = lambda *x: rng.choice(x)

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() + pick("", "", "", ",", ".") for _ in range(rng.randint(0, k)))

    def secret() -> tuple[str, str, str]:
        if rng.random() < 0.15:
            return key_block()
        name = pick("token", "secret", "api_key", "apiKey", "password", "access_key", "AWS_SECRET_ACCESS_KEY", "client_secret", "auth_token", "DB_PASSWORD", "private_key", "Authorization: Bearer", "signing-key")
        q = pick('"', "'", "")
        value = pick(
            some(hexa, pick(32, 40, 64)), some(hexa, 40), some(b64, pick(24, 32, 40, 43)), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36),
            "sk-" + some(alnum, 32), "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), "AIza" + some(alnum + "-_", 35), "eyJ" + some(alnum, 17) + "." + some(alnum, 40) + pick("", "." + some(alnum, 43)),
            word() + some("!@#$%^&*", 2) + some(alnum, 6), some(alnum, pick(10, 12, 16, 20)), some(alnum + "!@#%^*-_", pick(12, 16, 24)),
            some(pick(b64, alnum, alnum + "-_"), pick(64, 128, 256, 513, 1200, 5000)),
        )
        if value.startswith(PREFIXES) and rng.random() < 0.5:
            return "", value, ""
        return f"{name}{pick(' = ', '=', ': ', ':')}{q}", value, q

    def block(body: str) -> tuple[str, str, str]:
        """A key between its marks: bare, in quoted or escaped code, with headers, or without its END mark."""
        kind, line = pick("", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "), pick("\n", "\n", "\n", "\\n", " ")
        head = f"Proc-Type: 4,ENCRYPTED{line}DEK-Info: AES-256-CBC,{some(hexa.upper(), 32)}{line}{line}" if line != " " and rng.random() < 0.15 else ""
        end = f"{line}-----END {kind}PRIVATE KEY-----" if line == " " or rng.random() < 0.9 else ""
        q = pick('"', "'", '"""', "")
        lead = pick("", "", "", "", q, f"{word()} = {q}", f"private_key: {q}", f'"key": {q}', f"PRIVATE_KEY={q}", f"{word()}: |{line}", "key.pem\n")
        return lead, f"-----BEGIN {kind}PRIVATE KEY-----{line}{head}{body if line == ' ' else line.join(body[i : i + 64] for i in range(0, len(body), 64))}{end}", q if q and lead.endswith(q) else ""

    def key_block() -> tuple[str, str, str]:
        n = rng.choice([48, 100, 300, 800, 1200, 1700, 2350, 4700, 6300]) + rng.randint(0, 40)
        return block(pick("", "MII", "MIIE", "b3BlbnNzaC1rZXktdjE") + some(b64, n) + pick("", "=", "=="))

    def empty_block() -> tuple[str, str, str]:
        """Marks around what stands for a key."""
        return block(pick("your private key here", "...", "PASTE YOUR KEY HERE", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "redacted", "MIIE...", "", "example", "placeholder " + word(), " ".join(word() for _ in range(rng.randint(3, 30)))))

    def plain() -> tuple[str, str, str]:
        if rng.random() < 0.06:
            return empty_block()
        q = pick('"', "'", "")
        word_ = "_".join(word() for _ in range(rng.randint(2, 5)))
        return pick(
            (f"{pick('commit ', 'sha1: ', 'revision = ', 'rev ', 'etag: ')}", some(hexa, 40), ""),
            (f"{pick('sha256:', 'checksum = ', 'md5: ', 'digest=', 'integrity: ', 'hash ')}{q}", some(hexa, pick(32, 64)), q),
            (f"{pick('id = ', 'uuid: ', 'session id: ', 'request_id=')}{q}", f"{some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}", q),
            (f"{pick('token', 'password', 'secret', 'api_key')} = {q}", pick("changeme", "your_token_here", "example-password", "<password>"[1:-1] + "_goes_here", "xxxxxxxxxxxxxxxx", "placeholder", "test_secret_value", "None_or_null", "insert-your-key-here"), q),
            (f"{pick('token', 'password', 'secret', 'key', 'auth')}{pick(' = ', ': ')}", pick(word_, "os.environ", "get_" + word_, "config." + word_, "self." + word_, "settings." + word_.upper()), ""),
            (f"{pick('title', 'name', 'note', word())}: ", word() + word(), ""),
            (f"{pick('order', 'invoice', 'tel', 'isbn', word())}: ", some(string.digits, rng.randint(6, 20)), ""),
            (f"{pick('href', 'src', 'url')}={q}", pick("http://", "https://www.", "/") + word() + ".com/" + word() + "/" + some(string.digits, 5), q),
            ("", word_ + some(string.digits, 2) + "_" + word_, ""),
            ("", "-".join(word() for _ in range(5)) + "-" + some(string.digits, 3), ""),
            ("version: ", f"{rng.randint(0, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 3000)}", ""),
            (f"{pick('date', 'time')}: ", f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}", ""),
            ("data:image/png;base64,", "iVBORw0KGgo" + some(b64, rng.randint(60, 300)), ""),
        )

    out: list[tuple[str, int, int, str, int]] = []
    while len(out) < n:
        label = len(out) % 2
        lead, value, tail = secret() if label else plain()
        head = prose(8)
        text = f"{head}{pick(' ', chr(10)) if head else ''}{lead}{value}{tail}{pick(' ', chr(10), '### ', '.')}{prose(6)}"
        path = pick("", "src", "web", word(), f"{word()}.py", f"config/{word()}.env") if label or rng.random() < 0.6 else pick("tests/" + word(), "docs/example.md", "package.lock", "examples/a.py")
        raw = text.encode()
        at = len((text[: text.index(value, len(text) - len(text) + len(head))]).encode())
        found = [c for c in candidates(raw) if c[0] <= at + len(value.encode()) - 1 and at < c[1]]
        if found:
            out.append((text, found[0][0], found[0][1], path, label))
    return out


def kind_of(raw: bytes, start: int, end: int) -> str:
    return next((k for s, e, k in candidates(raw) if (s, e) == (start, end)), "run")


_FOREST: dict[tuple, Forest] = {}


def default_forest(n: int = 3000, seed: int = 5) -> Forest:
    if (n, seed) not in _FOREST:
        _FOREST[n, seed] = fit(labelled_findings(n, seed))
    return _FOREST[n, seed]


def fit(findings: list[tuple[str, int, int, str, int]], **options) -> Forest:
    """A forest from labelled findings (text, start, end in bytes, path, label)."""
    x = [describe(t.encode(), s, e, kind_of(t.encode(), s, e), p) for t, s, e, p, _ in findings]
    return train(np.array(x), np.array([y for *_, y in findings]), **options)


def judge(texts: list[bytes], paths: list[str], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) in bytes of each text's candidates."""
    out: list[list] = [[] for _ in texts]
    where, x = [], []
    for i, t in enumerate(texts):
        for s, e, kind in candidates(t):
            where.append((i, s, e, kind))
            x.append(describe(t, s, e, kind, paths[i]))
    if x:
        for (i, s, e, kind), p in zip(where, forest(np.array(x)).tolist(), strict=True):
            out[i].append((s, e, kind, p))
    return out


FINDING = "kind string, start long, length long, fingerprint string, score double, is_secret boolean"


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", path_col: str | None = "source", forest: Forest | None = None) -> DataFrame:
    """A row per candidate: columns ``keep``, FINDING; start and length in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    kept = docs.select(*keep).schema
    path = F.col(path_col) if path_col else F.lit("")

    def run(batches):
        for batch in slices(batches, "__text"):
            texts = texts_of(batch, "__text")
            paths = ["" if p is None else p for p in batch.column(batch.schema.get_field_index("__path")).to_pylist()]
            rows, found = [], {k.split()[0]: [] for k in FINDING.split(", ")}
            for i, own in enumerate(judge(texts, paths, sent.value)):
                before = start = 0
                for s, e, kind, p in own:
                    rows.append(i)
                    value = texts[i][s:e]
                    start += len(texts[i][before:s].decode("utf-8", "replace"))
                    before = s
                    for k, v in zip(found, (kind, start, len(value.decode("utf-8", "replace")), hashlib.sha256(value).hexdigest()[:16], p, p >= THRESHOLD), strict=True):
                        found[k].append(v)
            at = pa.array(rows, pa.int64())
            out = {f.name: batch.column(batch.schema.get_field_index(f.name)).take(at) for f in kept}
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_pydict(out | {k: pa.array(v, t) for (k, v), t in zip(found.items(), kinds, strict=True)})

    return docs.select(*keep, F.col(text_col).alias("__text"), path.cast("string").alias("__path")).mapInArrow(lean(run), extended(kept, FINDING))


def redacted(text: bytes, found: list[tuple[int, int, str, float]], threshold: float = THRESHOLD) -> bytes:
    out, at = [], 0
    for s, e, kind, p in found:
        if p >= threshold:
            out += [text[at:s], b"[secret]"]
            at = e
    return b"".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", count_col: str | None = "n_chars", forest: Forest | None = None) -> DataFrame:
    """All rows and columns, with secrets in the text replaced; ``count_col`` holds its length in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    names = docs.columns

    def run(batches):
        for batch in slices(batches, text_col):
            texts, at = texts_of(batch, text_col), names.index(text_col)
            paths = ["" if p is None else p for p in batch.column(names.index(path_col)).to_pylist()] if path_col in names else [""] * len(texts)
            changed, columns = {}, [batch.column(i) for i in range(batch.num_columns)]
            for i, own in enumerate(judge(texts, paths, sent.value)):
                if any(p >= THRESHOLD for *_, p in own):
                    changed[i] = redacted(texts[i], own)
            if changed:
                held = columns[at].to_pylist()
                for i, t in changed.items():
                    held[i] = t.decode("utf-8", "replace")
                columns[at] = pa.array(held, columns[at].type)
                if count_col in names:
                    k = names.index(count_col)
                    sizes = columns[k].to_pylist()
                    for i in changed:
                        sizes[i] = len(held[i])
                    columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)


def op3_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
