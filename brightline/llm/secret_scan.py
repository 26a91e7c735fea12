"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is the body of a private key block, the password of user:password@ in a link, a value of 6 or more characters without white space
that a name with a key word is set to (by =, :, := or =>, or as an XML element), or a run of 16 or more characters that keys and tokens are made
of, without the name before a '='. Its features: how it was found, length, character transitions, coverage by dictionary words, the path
of the document, and the words before it. A random forest, fitted with Spark ML on labelled texts whose candidates are found in the same
way, tells secrets from long words, links, paths, numbers, digests, code and placeholders.

Documents are independent: there is no shuffle, and every text is scanned whole.

Defined results. A null or empty text has no findings. Equal candidates in one text are each reported; rows that repeat a document are
scanned each. A null source says nothing. Findings of one text do not overlap: where candidates do, the first kind named above that is
taken for a secret goes before the others. Values with white space are found in private key blocks only. Other columns pass through redact() unchanged.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.llm.trees import Tree, parsed, votes

LEAST_LENGTH = 16
PLACEHOLDER = "<secret>"
THRESHOLD = 0.5

#: '=' ends a name or pads a value: it is part of a run only where nothing of a run follows.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_.\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=.\-]))?")
#: A name with a key word, what sets it, and the value: within quotes, or up to white space, a quote or a separator.
ASSIGNED = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|credential|authorization|bearer|(?<![a-z])(?:auth|key)|(?-i:(?<=[a-z])Key)|(?<=access)key|(?<=private)key)s?(?:[_\-.][a-z0-9_\-.]{0,40})?
    ["'\]]{0,2}\s{0,3}(?::=|=>|[=:>])\s{0,3}(?:(?:bearer|basic|token)\s{1,3})?
    (?:"(?P<double>[^"\s]{6,})"|'(?P<single>[^'\s]{6,})'|["'`]?(?P<bare>[^\s"'`<>,;]{6,}))""",
    re.I | re.X,
)
USERINFO = re.compile(r"""://[^\s/:@"'<>]*:(?P<value>[^\s/@"'<>]{3,})@""")
KEY_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?P<value>(?:(?!-----).)+)-----END|\s*(?P<cut>(?:[A-Za-z0-9+/]{40,}={0,2}\s+)*[A-Za-z0-9+/]{40,}={0,2}))", re.S
)
#: Words that stand before a secret, that stand before a digest or identifier, and that mark test paths.
KEY_WORDS = frozenset("token secret password passwd pwd apikey api_key api-key key access_key access secret_key client_secret auth authorization bearer credential credentials private_key passphrase".split())
DIGEST_WORDS = frozenset("sha sha1 sha256 md5 digest checksum hash commit revision rev uuid guid id etag integrity isbn doi build version order card phone".split())
TEST_PATH_WORDS = frozenset("test tests example examples sample fixture fixtures mock doc docs".split())
KNOWN_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "rk_live_", "AIza", "eyJ", "npm_", "hf_", "SG.")
#: A dictionary of frequent words and word parts of prose and of names in code.
DICTIONARY = frozenset(
    "able about access account action admin after again all also and another any application archive are around article back base because been before "
    "being between block both build but buffer button cache call can case category change char check child class clean click client close cloud code "
    "column com command comment common component config connect console content context control copy could count create current data database date day "
    "default delete description design detail dev device did directory display document does down download each edit element email enable end engine "
    "entry environment error event every example exec experience export external factory fail field file filter find first flag font for form format "
    "found frame from full function game general get global good graph great group handle handler has have head header height help here high home host "
    "html http https icon image import index info information init input install instance int integer integration interface internal into item its java "
    "javascript job just key know label language last layout left length level library life like line link list little load local location log login long "
    "look loop made main make manager many map mark match max may media member memory menu message method might min mode model module more most much must "
    "name native navigation net network never new next node not note now null number object off office old only open option order other our out output over "
    "own package page param parent parse part password path pattern people place play plugin point port position post private process product profile "
    "program project property protected public query read record reference register release remote remove render report request require resource response "
    "result return right root route rule run same sample save say schema screen script search second section security see select send server service session "
    "set setting shared should show side simple single site size small some source stack start state static status step still store stream string style such "
    "support system table target task temp template test text than that the their them then there these they thing think this those through thumb time title "
    "today token tool total trace track transaction tree true type under update upload url use user util utility validation value variable vector version "
    "very video view visual wait want was way web well were what when where which while who width will window with word work world would write www year you "
    "your ing tion ment ness ally ough ight ence ance ible ture ster ther ation".split()
)

FEATURES = ("length", "transitions", "case_transitions", "digit_share", "entropy", "coverage", "letter_run", "parts", "prefix", "key_near", "digest_near", "url_like", "test_path", "symbols", "assigned", "userinfo", "key_block")
KINDS = ("key_block", "userinfo", "assigned", "run")


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def coverage(value: str, longest: int = 12) -> float:
    """Share of the characters that dictionary words of three letters or more cover, the longest word first at each place."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(longest, len(low) - at), 2, -1):
            if low[at : at + n] in DICTIONARY:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every candidate, in the order of KINDS; one that repeats a place is left out."""
    found = [(*m.span("value" if m["value"] else "cut"), "key_block") for m in KEY_BLOCK.finditer(text)]
    found += [(*m.span("value"), "userinfo") for m in USERINFO.finditer(text)]
    at = 0
    while m := ASSIGNED.search(text, at):
        name = next(k for k in ("double", "single", "bare") if m[k])
        a, b = m.span(name)
        if (inner := ASSIGNED.match(text, a)) and inner.end() >= b:  # a name set to another name that is set
            at = a
            continue
        at = b
        if name == "bare":
            first = m.start()
            while first and (text[first - 1].isalnum() or text[first - 1] in "_-."):
                first -= 1
            if first and text[first - 1] in "?&":  # a link's parameter
                b = text.index("&", a, b) if "&" in text[a:b] else b
            b = a + len(text[a:b].rstrip(".:)]}"))
        if b - a >= 6:
            found.append((a, b, "assigned"))
    found += [(*m.span(), "run") for m in CANDIDATE.finditer(text)]
    return list({f[:2]: f for f in reversed(found)}.values())[::-1]


def words_before(before: str) -> set[str]:
    """The last three words, and the parts of names among them."""
    words = set()
    for w in re.findall(r"[A-Za-z0-9_\-]+", before)[-3:]:
        parts = re.split(r"[_\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", w).lower())
        words |= {w.lower(), *parts}
    return words


def features(value: str, before: str, path: str, found_as: str) -> list[float]:
    """The FEATURES of a candidate of a kind, with what stands before it and the path of its document."""
    kinds = [kind(c) for c in value]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    counts = Counter(value)
    n = len(value)
    words = words_before(before)
    runs = [len(r) for r in re.findall(r"[A-Za-z]+", value)]
    path_words = re.findall(r"[a-z]+", path.lower())
    return [
        float(n), sum(a != b for a, b in pairs) / max(1, n - 1), sum({a, b} == {1, 2} for a, b in pairs) / max(1, n - 1), kinds.count(0) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), coverage(value), max(runs, default=0) / n, float(len(re.split(r"[/.\-_=+]+", value))),
        float(value.startswith(KNOWN_PREFIXES)), float(any(w in KEY_WORDS for w in words)), float(any(w in DIGEST_WORDS for w in words)),
        float("/" in value[:-1].strip("/") or "www." in value or ".com" in value or before.endswith("://")), float(any(w in TEST_PATH_WORDS for w in path_words)),
        kinds.count(3) / n, *(float(found_as == k) for k in ("assigned", "userinfo", "key_block")),
    ]


def labelled_texts(n: int, seed: int) -> Iterator[tuple[str, str | None]]:
    """n labelled texts by rule of each of two classes: the text, and the one secret in it or None."""
    r = random.Random(seed)
    hexdigits, base64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    syllables = "the ing er on an re ti es en at ed nd or st ha ou th le la ion ment eau que ch un ge ver sch keit heit lich der ado cion ta os mi en ez ra ll".split()
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda low, high: "".join(r.choices(syllables, k=r.randint(low, high)))
    prose = lambda: " ".join(word(1, 4) for _ in range(r.randint(2, 6)))
    vocabulary = sorted(DICTIONARY)
    names = "token secret password passwd pwd apikey api_key api-key key access_key secret_key client_secret auth_token credential private_key passphrase".split()

    def name() -> str:
        key = r.choice(("", "", "db_", "my_", "aws_", "app.")) + r.choice(names)
        return r.choice((key, key, key.upper(), re.sub(r"[_.\-](\w)", lambda m: m[1].upper(), key)))

    def password() -> str:
        while True:
            made = r.choice((lambda: pick(alnum + "!@#$%^&*?+-_", r.randint(8, 22)), lambda: word(2, 4).title() + pick(string.digits, r.randint(2, 4)) + pick("!@#$%*?", r.randint(1, 2)), lambda: pick(alnum, r.randint(8, 15))))()
            if any(c.isdigit() for c in made) and not made.isdigit() and made[-1].isalnum() | (made[-1] in "!@#$%*?"):
                return made

    def set_to(value: str) -> str:
        key = name()
        return r.choice((
            f'{key} = "{value}"', f"{key}={value}", f"{key}: {value}", f"{key} = '{value}'", f"{key}='{value}'", f'{key}="{value}"', f'"{key}": "{value}"', f"export {key}={value}", f"<{key}>{value}</{key}>",
        ))

    def secret() -> tuple[str, str]:
        prefixed = lambda: r.choice(KNOWN_PREFIXES) + pick(alnum, r.randint(16, 40))
        access = lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16)
        long = [
            lambda: pick(hexdigits, r.choice((32, 40, 64))), lambda: pick(hexdigits, 40), lambda: pick(hexdigits, 40).upper(), lambda: pick(base64, r.randint(24, 64)), lambda: pick(alnum, r.randint(16, 48)),
            prefixed, access, lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30),
        ]
        form = r.random()
        if form < 0.5:
            value = r.choice(long)()
            return set_to(value), value
        if form < 0.58:
            value = r.choice(long)()
            return f"{r.choice(('token', 'key', 'secret', 'Bearer', 'password'))} {value}", value
        if form < 0.66:
            value = r.choice((prefixed, access))()
            return value, value
        if form < 0.84:
            value = password()
            return set_to(value), value
        if form < 0.92:
            value = re.sub("[@/]", "x", password())
            return f"{r.choice(('https', 'postgres', 'amqp', 'mongodb'))}://{word(1, 3)}:{value}@{word(2, 3)}.com/{word(1, 2)}", value
        lines = r.choice(("\n", "\\n")).join(["", *(pick(base64, 64) for _ in range(r.randint(3, 20))), pick(base64, 30) + "==", ""])
        kind = r.choice(("", "RSA ", "EC ", "OPENSSH "))
        return f"-----BEGIN {kind}PRIVATE KEY-----{lines}-----END {kind}PRIVATE KEY-----", lines

    def harmless() -> str:
        placeholder = r.choice(("your_api_key_here", "example-secret-token", "replace.with.your.key", "insert_password_here", "my-test-access-token", "changeme", "password", "<password>", "string", "required", "undefined", "YOUR_TOKEN"))
        return r.choice([
            lambda: word(6, 12), lambda: word(6, 12).upper(), lambda: r.choice(("", "-", "_", ".", "/")).join(r.choices(vocabulary, k=r.randint(3, 6))),
            lambda: "".join(w.title() for w in r.choices(vocabulary, k=r.randint(3, 6))), lambda: pick(string.digits, r.randint(16, 24)),
            lambda: "https://www." + word(4, 4) + ".com/" + "/".join(r.choices(vocabulary, k=3)),
            lambda: r.choice(sorted(DIGEST_WORDS)) + r.choice((" ", ": ", "=")) + pick(hexdigits, r.choice((32, 40, 64))),
            lambda: r.choice(("", "id ", "uuid=")) + "-".join(pick(hexdigits, k) for k in (8, 4, 4, 4, 12)),
            lambda: set_to(r.choice("xX*.-_0") * r.randint(6, 40)), lambda: r.choice("xX*.-_0") * r.randint(16, 40), lambda: set_to(placeholder),
            lambda: set_to(word(3, 6)), lambda: f"{name()}: {prose()}", lambda: f"{name()}: {r.choice(vocabulary)}, {prose()}",
            lambda: f"{name()} = " + r.choice((f'os.environ["{name()}"]', f"get_{name()}()", f"self.{name()}", f"config.{r.choice(vocabulary)}.{name()}", "${" + name().upper() + "}", f"{r.choice(vocabulary)}({r.choice(vocabulary)})", f"process.env.{name().upper()}")),
            lambda: f"{name()}={'_'.join(r.choices(vocabulary, k=r.randint(2, 4)))}", lambda: f"{name()}: {pick(string.digits, r.randint(6, 10))}",
            lambda: f"https://{word(1, 3)}:{r.choice(('password', 'secret', 'pass', '${PASSWORD}', '********', 'xxxxxx'))}@{word(2, 3)}.com/",
            lambda: "-----BEGIN PRIVATE KEY-----" + r.choice(("\n...\n", "\nyour key here\n", " and ", "\n<key>\n")) + "-----END PRIVATE KEY-----",
            lambda: word(3, 3) + "." + pick(string.digits, 2) + "mail" + pick(string.digits, 1) + ".example.com",
        ])()

    around = lambda x: f"{prose()}{r.choice((' ', chr(10)))}{x}{r.choice((' ', chr(10)))}{prose()}"
    for _ in range(n):
        text, value = secret()
        yield around(text), value
        yield around(harmless()), None


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[float, ...]]:
    """The candidates of n labelled texts in each of two classes, as FEATURES, then 1 for a secret; of a secret's text, that one only."""
    r = random.Random(seed)
    rows = []
    for text, value in labelled_texts(n, seed):
        path = r.choice(("src", "docs", "tests/fixtures", "app/config", "web"))
        for a, b, found_as in candidates(text):
            if value is None or text[a:b] == value:
                rows.append((*features(text[a:b], text[max(0, a - 60) : a], path, found_as), float(value is not None)))
    return rows


def fitted_forest(spark: SparkSession) -> list[Tree]:
    """The forest, fitted on the labelled findings."""
    rows = spark.createDataFrame(labelled_findings(), [*FEATURES, "label"])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return parsed(RandomForestClassifier(numTrees=40, maxDepth=9, seed=3).fit(data).toDebugString)


def findings(text: str | None, path: str | None, forest: list[Tree]) -> list[tuple[int, int, float]]:
    """Start, end (in code points) and share of the trees' votes of each candidate that the forest takes for a secret."""
    if not text:
        return []
    found = candidates(text)
    if not found:
        return []
    rows = np.array([features(text[a:b], text[max(0, a - 60) : a], path or "", kind) for a, b, kind in found])
    taken: list[tuple[int, int, float]] = []
    for (a, b, _), v in zip(found, votes(forest, rows), strict=True):
        if v > THRESHOLD:
            at = bisect.bisect(taken, (a,))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b, float(v)))
    return taken


def scan(docs: DataFrame) -> DataFrame:
    """A row for each secret in docs (doc_id, text, source): doc_id, start, end, score and secret_sha256; never the secret itself."""
    forest = fitted_forest(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                rows += [(doc_id, a, b, v, hashlib.sha256(text[a:b].encode()).hexdigest()) for a, b, v in findings(text, path, forest)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "end", "score", "secret_sha256"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return columns.mapInArrow(run, "doc_id long, start int, end int, score double, secret_sha256 string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by PLACEHOLDER, and n_chars, if there, set to the new length; all rows stay."""
    forest = fitted_forest(docs.sparkSession)
    names = docs.columns
    text_at, path_at = names.index("text"), names.index("source")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None, path: str | None) -> str | None:
        out, at = [], 0
        for a, b, _ in findings(text, path, forest):
            out += [text[at:a], PLACEHOLDER]
            at = b
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[text_at].to_pylist()
            new = [clean(t, p) for t, p in zip(old, columns[path_at].to_pylist(), strict=True)]
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if chars_at is not None:
                n = [c if a == b else len(b) for a, b, c in zip(old, new, columns[chars_at].to_pylist(), strict=True)]
                columns[chars_at] = pa.array(n, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return inner.mapInArrow(run, inner.schema).toDF(*names)
