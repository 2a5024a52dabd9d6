"""Secrets in texts: candidate strings, and a random forest that removes false positives.

A candidate is what a key word such as ``password`` or ``api_key`` introduces (six printable
characters or more), or any run of 16 or more letters, digits and ``+/_.-``. Nothing else is left out before the
forest sees it. The forest looks at length, changes of character class, coverage by dictionary words,
the words before and after, and the document's path. It is trained on labelled findings (built-in
ones, or a table of the same columns) and becomes one sum of conditional expressions, so finding,
scoring and masking are all Spark expressions on one row: nothing is shuffled and no text leaves its row.

A text is marked once where candidates start and end, and cut at the marks. A finding is a place: masking
replaces the places that the forest calls secrets and no other occurrence of the same string.

Null and empty texts hold no findings; a null path is an empty one. A candidate that occurs twice is
found twice, and repeated rows repeat. Ties (a score of exactly the threshold) count as secrets. Columns of the input are kept whatever their
names by ``mask_secrets``; ``scan_secrets`` returns its own columns only. A very long text is cut into as many pieces as it
has candidates, and none is left out. Empty tables give empty tables.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "[SECRET]"
_SPACE, _NAME, _VALUE = r"[\x20\x09-\x0D]", r"[A-Za-z0-9_.\-]", r"[^\x00-\x20\"'`<>,;(){}\[\]"
#: What introduces a secret: a name that holds a key word and is assigned, or a key word alone.
KEY = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_.\-]?key|access[_.\-]?key|private[_.\-]?key|credentials?|bearer|auth)"
_ASSIGNED = rf"{_NAME}{{0,20}}[\"'`\]]{{0,2}}{_SPACE}{{0,3}}(?:=>|:=|={{1,3}}|:){_SPACE}{{0,3}}[\"'`]?"
_ALONE = rf"[\"'`]?{_SPACE}{{1,3}}[\"'`]?"
KEYED = rf"(?<!{_NAME})({_NAME}{{0,40}}?{KEY}(?:{_ASSIGNED}|{_ALONE}))({_VALUE}]{{5,}}{_VALUE}.:!?])"
RUN = r"[A-Za-z0-9+/_.\-]{16,}={0,2}"
CANDIDATE = f"{KEYED}|({RUN})"
#: Marks put around candidates; in texts they are written as pairs that start with the second.
_MARK, _ESCAPE = "\x01", "\x02"
#: Characters around a candidate that its neighbouring words are taken from.
AROUND = 80

# Common words and syllables of English and of source code, of three letters or more.
DICTIONARY = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who did its let say she too use that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were what work first after other about could would these there which their people should house world where right think still every number system public state name data file user admin test example sample home page site mail info list item type value class method function return import package module library version build release config service server client node index image video audio style script main java python http https www com org net html json text local share source include default demo dummy change placeholder password secret token access key"
).split()
KEY_WORDS = rf"{KEY}[^A-Za-z]*\z|{KEY}{_ASSIGNED}\z"
HASH_WORDS = r"(?i)(commit|sha-?[0-9]*|md5|checksum|hash|digest|etag|uuid|guid|revision|blob|trace|request|build|version|order|invoice|phone|card)"
TEST_PATH, CONFIG_PATH = r"(?i)(^|[/_.\-])(tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?|readme|locks?|dist|vendor)([/_.\-]|$)", r"(?i)([.](env|ini|ya?ml|toml|properties|conf|cfg|pem|key)$|config|settings|credential)"
FEATURES = (
    "length", "transitions", "digits", "uppers", "symbols", "specials", "classes", "hex", "distinct", "vowels", "dictionary", "slashes", "dots", "address", "key_word", "hash_word", "hash_after", "assigned", "quoted", "word_after", "test_path", "config_path",
)


def _with(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _escaped(text: Column) -> Column:
    pairs = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    return F.when(text.rlike(f"[{_MARK}{_ESCAPE}]"), pairs).otherwise(text)


def _plain(text: Column) -> Column:
    pairs = F.replace(F.replace(text, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
    return F.when(F.contains(text, F.lit(_ESCAPE)), pairs).otherwise(text)


def pieces(text: Column) -> Column:
    """The text cut at its candidates: every second piece is one. The pieces joined, each by _plain, are the text."""
    return F.split(F.regexp_replace(_escaped(text), CANDIDATE, f"$1{_MARK}$2$3{_MARK}"), _MARK)


def _context(parts: Column, i: Column) -> dict[str, Column]:
    """Two words and the rest of a word before the candidate at place i, the candidate, and the rest of a word and a word after it."""
    before = F.concat(F.coalesce(F.get(parts, i - 2), F.lit("")), F.get(parts, i - 1))
    return {
        "before": F.regexp_extract(F.substring(before, -AROUND, AROUND), rf"(?s)(?:[^\x20\x09-\x0D]+{_SPACE}+){{0,2}}[^\x20\x09-\x0D]*\z", 0),
        "string": _plain(F.get(parts, i)),
        "after": F.regexp_extract(F.substring(F.get(parts, i + 1), 1, AROUND), rf"^[^\x20\x09-\x0D]*(?:{_SPACE}+[^\x20\x09-\x0D]+)?", 0),
    }


def candidates(text: Column) -> Column:
    """Structs (before, string, after) of the candidates of a text, in order."""
    return _with(pieces(text), lambda p: F.filter(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.struct(*(v.alias(k) for k, v in _context(p, i).items())))), lambda x: x.isNotNull()))


def features(before: Column, s: Column, after: Column, path: Column) -> dict[str, Column]:
    """FEATURES of a candidate, as doubles."""
    n = F.length(s).cast("double")
    share = lambda pattern: F.regexp_count(s, F.lit(pattern)) / n
    flag = lambda c: c.cast("int").cast("double")
    bare = F.length(F.regexp_replace(F.lower(s), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    return {
        "length": n,
        "transitions": share(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[A-Z])(?=[a-z])|(?<=[0-9])(?=[A-Za-z])"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "specials": share(r"[^A-Za-z0-9+/_.=\-]"),
        "classes": sum((flag(s.rlike(c)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "hex": flag(s.rlike("^([0-9a-f]+|[0-9A-F]+)\\z")),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / n,
        "vowels": share("[aeiouAEIOU]"),
        "dictionary": 1 - bare / n,
        "slashes": share("/"),
        "dots": share(r"[.\-]"),
        "address": flag(F.concat(before, s, after).rlike("@[A-Za-z0-9]+[.]|://|www[.]")),
        "key_word": flag(before.rlike(KEY_WORDS)),
        "hash_word": flag(before.rlike(HASH_WORDS)),
        "hash_after": flag(after.rlike(HASH_WORDS)),
        "assigned": flag(before.rlike(r"[=:>]\s*[\"'`]?\z")),
        "quoted": flag(before.rlike("[\"'`]\\z") & after.rlike("^[\"'`]")),
        "word_after": flag(after.rlike(r"^[A-Za-z0-9]|^\s+[a-z]+\z")),
        "test_path": flag(path.rlike(TEST_PATH)),
        "config_path": flag(path.rlike(CONFIG_PATH)),
    }


def labelled_findings(count: int = 2400, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Built-in findings (before, string, after, path, label): generated secrets, and what is often taken for one."""
    r = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(r.choices(alphabet, k=r.randint(a, b)))
    b62, hexes, url = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-"
    syllables = ["th", "er", "in", "ou", "ing", "an", "re", "on", "es", "tion", "ver", "zu", "keit", "la", "que", "ment", "ado", "ble", "ch", "ly"]
    words = lambda a, b: [r.choice(DICTIONARY) for _ in range(r.randint(a, b))]
    made = lambda a, b: "".join(r.choices(syllables, k=r.randint(a, b)))
    plain = lambda: " ".join(made(1, 3) if r.random() < 0.5 else r.choice(DICTIONARY) for _ in range(r.randint(1, 2)))
    keyed = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "PRIVATE_KEY", "credential", "TOKEN", "client_secret", "pwd", "DB_PASSWORD", "passwd", "user.password", "Secret"])
    source = lambda: r.choice(["", "", "src1", "web", f"src/{made(1, 2)}.py", f"{made(1, 2)}/{made(1, 2)}.txt"])
    forms = [(' = "', '"'), (": '", "'"), ("=", ""), (" = ", ","), (": ", ""), ('": "', '",'), (" := `", "`"), ("=", " " + made(1, 2)), (' = "', '" ' + made(1, 2)), ('="', '" ' + r.choice(DICTIONARY))]

    def password() -> str:
        word = r.choice([made(2, 4), "".join(words(1, 2)), pick("bcdfghjklmnpqrstvwxz", 3, 9)])
        return r.choice([word + str(r.randint(1, 9999)), word.title() + str(r.randint(1, 99)) + r.choice("!@#$%&*?+") + made(0, 1), pick("qwrtzpsdfghjklyxcvbnm", 8, 22), pick(b62 + "!@#$%^&*", 8, 16), word.replace("o", "0").replace("a", "4").replace("e", "3") + r.choice("!$#@7")])

    strong = [
        lambda: pick(hexes, 32, 64), lambda: pick(hexes, 40, 40), lambda: pick(b62, 20, 48), lambda: pick(b62 + "+/", 40, 40) + "=", lambda: pick(hexes.upper(), 40, 40), lambda: pick(b62, 16, 24), password, password, password, lambda: pick("bcdfghjklmnpqrstvwxyz", 10, 26), lambda: pick(string.ascii_lowercase, 16, 26),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + pick(b62, 36, 36), lambda: "eyJ" + pick(url, 20, 30) + "." + pick(url, 30, 60), lambda: "sk_live_" + pick(b62, 24, 32),
    ]
    good, bad = [], []
    for k in range(count // 2):
        kind = k % (len(strong) + 1)
        s = strong[min(kind, len(strong) - 1)]()
        lead, tail = r.choice(forms)
        before = (plain() + " " if r.random() < 0.6 else "") + keyed() + lead
        if kind < 6 and r.random() < 0.45:
            before, tail = r.choice(["", plain() + " "]) + r.choice(["Bearer ", "bearer ", "token ", "Token ", "secret ", "api key ", "auth "]), r.choice(["", ".", " " + plain()])
        if kind >= 9 and r.random() < 0.5:
            before, tail = plain() + " ", r.choice(["", ".", ",", " " + plain()])
        good.append((before, s, tail, r.choice([source(), source(), "config/app.env", "settings.yaml"]), 1))
    for k in range(count - count // 2):
        kind = k % 18
        before, after = plain() + " ", r.choice(["", ".", ",", '"', ")", " " + plain()])
        if kind == 0:
            before, s = plain() + " " + r.choice(["commit ", "sha1 ", "md5 = ", "checksum: ", "hash ", "revision ", 'etag: "', "see commit "]), pick(hexes, 32, 40)
        elif kind == 1:
            before, s = plain() + " " + r.choice(["id ", "uuid ", "request ", "trace = "]), "-".join(pick(hexes, n, n) for n in (8, 4, 4, 4, 12))
        elif kind == 2:
            s = "/" + "/".join(words(3, 6)) + str(r.randint(1, 99))
        elif kind == 3:
            s, before = ".".join([*(made(1, 3) for _ in range(r.randint(1, 3))), str(r.randint(10, 99))]), plain() + " " + r.choice(["http://", "https://www.", ""])
            s, after = s + "-" + "-".join(words(2, 4)), "@" + r.choice(["mail.example.com", "example.org"])
        elif kind == 4:
            before, s = plain() + " " + r.choice(["", "call ", "card ", "order "]), pick(string.digits, 16, 19)
        elif kind == 5:
            s = "".join(w.title() for w in words(4, 7)) + str(r.randint(0, 9))
        elif kind == 6:
            lead, after = r.choice(forms)
            before, s = keyed() + lead, r.choice(["-", "_"]).join([*words(2, 5), r.choice(["", str(r.randint(1, 999))])]).strip("-_")
        elif kind == 7:
            s = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.{r.randint(0, 59):02}"
        elif kind == 8:
            s = "_".join(words(3, 5)) + "_" + str(r.randint(1, 2048))
        elif kind == 9:
            s = "-".join([*words(1, 2), ".".join(str(r.randint(0, 20)) for _ in range(4)), "release"])
        elif kind in (10, 11):
            s = made(6, 11)
            s = s.upper() if r.random() < 0.2 else s.title() if r.random() < 0.3 else s
            s += r.choice(["", "", ".", "-" + made(1, 4)])
        elif kind in (12, 13):
            # a key word in prose, the next word after it
            before, s = plain() + " " + r.choice(["the secret ", "password ", "a token ", "their credentials ", "auth ", "secret ", "Token "]), r.choice([made(2, 5), *words(1, 1), "service", "recovery", "required", "manager"]) + r.choice(["", "", "s"])
        elif kind == 14:
            before, s = keyed() + r.choice([": ", " = ", "=", ' = "']), r.choice(["required", "string", "changeme", "undefined", "your_password", "your-token-here", "example", "placeholder", "os.environ.get", "process.env.TOKEN", "getpass.getpass", "config.secret", "********", "xxxxxxxx", "hidden", "disabled", "optional", "basic_auth", "self.password", "$PASSWORD", "$DB_PASSWORD", "None,None"])
        elif kind == 15:
            # what stands in fixtures is seldom a secret
            lead, after = r.choice(forms)
            before, s = keyed() + lead, r.choice([pick(hexes, 32, 40), password(), "test" + password()])
        elif kind == 16:
            before, s = plain() + " " + r.choice(["version ", "build ", "file ", "see "]), ".".join([*(made(1, 3) for _ in range(3)), made(1, 2)])
        else:
            before, s, after = plain() + " ", pick(hexes, 32, 40), r.choice([" checksum", " commit", " (sha1)", " md5 " + made(1, 2), " hash"])
        path = r.choice(["tests/fixtures/app.json", "docs/readme.md", "examples/login.py", "spec/auth_spec.rb"]) if kind == 15 else source()
        bad.append((before, s or "placeholder", after, path, 0))
    return good + bad


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 3):
    """A leaf (share of label 1) or (feature, threshold, tree up to it, tree above it), by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return round(share, 4)
    best = (1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order].cumsum()
        n = np.arange(1, len(y) + 1)
        at = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (n[:-1] <= len(y) - least))
        if not len(at):
            continue
        a, na = t[at], n[at]
        b, nb = t[-1] - a, len(y) - na
        gain = share * (1 - share) - (a * (na - a) / na + b * (nb - b) / nb) / len(y)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return round(share, 4)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[low], y[low], rng, depth - 1, least), grow_tree(x[~low], y[~low], rng, depth - 1, least)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 7, seed: int = 11) -> list:
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        out.append(grow_tree(x[own], y[own], rng, depth))
    return out


def tree_column(tree, value) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, limit, low, high = tree
    return F.when(value(FEATURES[f]) <= F.lit(limit), tree_column(low, value)).otherwise(tree_column(high, value))


def train_forest(spark: SparkSession, findings: Sequence[tuple[str, str, str, str, int]] | DataFrame | None = None, max_rows: int = 5000) -> list:
    """A forest from labelled findings (before, string, after, path, label); at most max_rows of a table, by hash."""
    names = ("before", "string", "after", "path")
    if isinstance(findings, DataFrame):
        rows = findings.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in names), "label").where("string <> '' AND label IS NOT NULL")
        rows = rows.orderBy(F.xxhash64(*names, "label"), *names, "label").limit(max_rows)
    else:
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        values = ", ".join("(" + ", ".join(map(quoted, x[:4])) + f", {x[4]})" for x in (findings if findings is not None else labelled_findings()))
        rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(before, string, after, path, label)")
    columns = features(*map(F.col, names))
    found = [tuple(r) for r in rows.select(*(columns[f].alias(f) for f in FEATURES), F.col("label").cast("double")).collect()]
    data = np.array(found, float).reshape(-1, len(FEATURES) + 1)
    return grow_forest(data[:, :-1], data[:, -1]) if len(data) else [0.0]


def _score(context: dict[str, Column], path: Column, forest: list) -> Column:
    values = F.struct(*(v.alias(k) for k, v in features(context["before"], context["string"], context["after"], path).items()))
    total = lambda f: F.round(sum((tree_column(t, lambda name: f[name]) for t in forest), F.lit(0.0)) / len(forest), 6)
    return _with(values, total)


def _path(path: Column | None) -> Column:
    return F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))


#: Pieces whose lengths are added up together.
GROUP = 512


def _lengths_before(parts: Column) -> Column:
    """For each piece, the characters of the text before it: sums within groups, then of groups."""
    def sums(lengths, zero):
        start = F.struct(F.array().cast("array<long>").alias("out"), zero.alias("total"))
        return F.aggregate(lengths, start, lambda a, n: F.struct(F.array_append(a["out"], a["total"]).alias("out"), (a["total"] + n).alias("total")), lambda a: a["out"])

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GROUP).cast("int")), lambda g: F.transform(F.slice(parts, g * GROUP + 1, GROUP), lambda x: F.length(_plain(x)).cast("long")))

    def with_groups(lengths):
        starts = sums(F.transform(lengths, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long"))
        return F.flatten(F.zip_with(lengths, starts, lambda x, s: sums(x, s)))

    return _with(groups, with_groups)


def findings(text: Column, forest: list, path: Column | None = None) -> Column:
    """Structs (start, before, string, after, score) of all candidates of a text; start counts characters from 0."""
    where = _path(path)

    def of_pieces(p):
        def one(x, i, start):
            context = _context(p, i)
            return F.struct(start.alias("start"), *(context[k].alias(k) for k in ("before", "string", "after")), _score(context, where, forest).alias("score"))

        found = _with(_lengths_before(p), lambda starts: F.transform(p, lambda x, i: F.when(i % 2 == 1, one(x, i, F.get(starts, i)))))
        return F.filter(F.when(F.size(p) > 1, found), lambda x: x.isNotNull())

    return F.coalesce(_with(pieces(text), of_pieces), F.array())


def scan_secrets(df: DataFrame, key: str, text: str, forest: list, threshold: float = 0.5, path: str | None = None) -> DataFrame:
    """One row for each candidate: (key, start, length, masked, string_sha256, score, is_secret)."""
    where = None if path is None else F.col(path)
    out = df.select(F.col(key).alias("key"), F.explode(findings(F.coalesce(F.col(text), F.lit("")), forest, where)).alias("f"))
    return out.select(
        F.col("key").alias(key), F.col("f.start").alias("start"), F.length("f.string").cast("long").alias("length"),
        F.concat(F.substring("f.string", 1, 2), F.lit("...")).alias("masked"), F.sha2(F.col("f.string").cast("binary"), 256).alias("string_sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret"),
    )


def mask_secrets(text: Column, forest: list, threshold: float = 0.5, path: Column | None = None) -> Column:
    """The text with each secret, where it was found, replaced by MASK; null stays null."""
    where = _path(path)

    def of_pieces(p):
        secret = lambda i: _score(_context(p, i), where, forest) >= threshold
        return F.array_join(F.transform(p, lambda x, i: F.when((i % 2 == 1) & secret(i), MASK).otherwise(_plain(x))), "")

    return _with(pieces(text), lambda p: F.when(F.size(p) > 1, of_pieces(p)).otherwise(text))
