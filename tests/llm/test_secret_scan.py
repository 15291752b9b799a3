import hashlib
import re
import time
from collections import Counter

import pytest

from docnest.llm import secret_scan as s
from tests.llm.texts import bag, frame, odd_rows

LITERAL = "qX7t-9Lm2_vB4kRz"


def values(text):
    return [text[a:b] for kind, a, b in s.literal_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'db_password = "{LITERAL}"', [LITERAL]),
        (f"accessKey: '{LITERAL}'", [LITERAL]),
        (f'{{"client_secret": "{LITERAL}", "name": "{LITERAL}"}}', [LITERAL]),
        (f'K = "{LITERAL}"\nother = 3\nclient.auth_token = K', [LITERAL]),
        (f'A = "{LITERAL}"; B = A; api_key := B', [LITERAL]),
        ('token = "qX7t9Lm2" + "vB4kRz11"', ["qX7t9Lm2", "vB4kRz11"]),
        (f"export PASSWORD={LITERAL}", [LITERAL]),
        (f'title = "{LITERAL}"', []),
        ('password = "changeme"', []),
        ('password = "${DB_PASSWORD}"', []),
        ('secret: "two words here"', []),
        ("the token: it was a word", []),
        ("see https://example.org/token/index.html for more", []),
    ],
)
def test_literals(text, want):
    assert values(text) == want


LONG = LITERAL * 300
PEM = "-----BEGIN PRIVATE KEY-----\\nMIIEvQ9xK2\\n-----END PRIVATE KEY-----"
LINES = PEM.replace("\\n", "\n")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'client_key_secret = "{LONG}"', [LONG]),
        (f"secret_{'x' * 300} = '{LITERAL}'", [LITERAL]),
        (f'"secret {"x" * 300}": "{LITERAL}"', [LITERAL]),
        (f'{{"private_key": "{PEM}", "a": 1}}', [PEM]),
        (f'private_key = """{LINES}"""', [LINES]),
        (f"const apiToken = `{LITERAL}`", [LITERAL]),
        (f"privateKey: `{LINES}`", [LINES]),
        ('PREFIX = "qX7t"\nSUFFIX = "9Lm2_vB4"\napi_secret = PREFIX + SUFFIX', ["qX7t", "9Lm2_vB4"]),
        ('PREFIX = "qX7t"\nSUFFIX = "9Lm2_vB4"\napi_secret = PREFIX+SUFFIX', ["qX7t", "9Lm2_vB4"]),
        ('P = "qX7t"\nJ = P + "-9Lm2"\napi_secret = J + "_vB4"', ["qX7t", "-9Lm2", "_vB4"]),
        (f'api_secret = load_it + "{LITERAL}"', [LITERAL]),
        ('token = "qX7t9Lm2" +\n    "vB4kRz11"', ["qX7t9Lm2", "vB4kRz11"]),
        (f"run --db.password={LITERAL}", [LITERAL]),
        (f'text = """\npassword = "{LITERAL}"\n"""', [LITERAL]),
        (f"TOKEN=ab+cd/ef12+\nPASSWORD={LITERAL}", ["ab+cd/ef12+", LITERAL]),
        ('secret = """two\nwords here"""', []),
    ],
)
def test_literals_of_any_length_and_form(text, want):
    assert values(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'os.environ["API_KEY_VALUE"] = "{LITERAL}"', [LITERAL]),
        (f"config['client_secret_key'] = '{LITERAL}'", [LITERAL]),
        (f'passphrase = ("{LITERAL}")', [LITERAL]),
        ('passphrase = (\n    "qX7t-9Lm2"\n    "_vB4kRz"\n)', ["qX7t-9Lm2", "_vB4kRz"]),
        (f"tokens_secret = [\n  '{LITERAL}',\n  'a1-{LITERAL}',\n]", [LITERAL, f"a1-{LITERAL}"]),
        ('api_secret = "".join(["qX7t", "9Lm2", "_vB4"])', ["qX7t", "9Lm2", "_vB4"]),
        (f'user, password = "someone", "{LITERAL}"', [LITERAL]),
        (f'password, user = "{LITERAL}", "someone-12"', [LITERAL]),
        (f'class C:\n    K = "{LITERAL}"\n\nclient(token=C.K)', [LITERAL]),
        (f'auth_token = K\nK = "{LITERAL}"', [LITERAL]),
        ("const P = 'qX7t-9Lm2'\nconst apiToken = `${P}_vB4kRz`", ["qX7t-9Lm2", "${P}_vB4kRz"]),
        ('P = "qX7t-9Lm2"\napi_token = f"{P}_vB4kRz"', ["qX7t-9Lm2", "{P}_vB4kRz"]),
        (f"base: &key_anchor {LITERAL}\nother:\n  api_token: *key_anchor\n", [LITERAL]),
        (f"private_key: |\n  {LINES.replace(chr(10), chr(10) + '  ')}\nname: x", [LINES.replace("\n", "\n  ")]),
        (f'<user name="x" password="{LITERAL}"/>', [LITERAL]),
        (f"<client_secret>{LITERAL}</client_secret>", [LITERAL]),
        (f"<title>{LITERAL}</title>", []),
        (f'passphrase = os.getenv("X_PASSPHRASE", "{LITERAL}")', [LITERAL]),
        (f'passphrase = os.environ.get("X_PASSPHRASE") or "{LITERAL}"', [LITERAL]),
        (f"const token = process.env.API_TOKEN || '{LITERAL}'", [LITERAL]),
        ('passphrase = os.getenv("DATABASE_PASSPHRASE_KEY")', []),
        ('passphrase = os.environ["DATABASE_PASSPHRASE_1"]', []),
        (f'connect(host="h", password="{LITERAL}")', [LITERAL]),
        (f'conn = connect("host", password=decode("{LITERAL}"))', [LITERAL]),
        ("password = getpass.getpass_from_user()", []),
        ("token = request.headers.get('X-Auth-Token-12')", []),
        ("A = B\nB = A\ntoken = A", []),
    ],
)
def test_syntax_of_values(text, want):
    assert values(text) == want


def test_joins_of_joins_take_time_in_proportion():
    for text in (
        'a = "qX7t"\n' + "a = a + a\n" * 20_000 + "token = a", 'token = "qX7t"\n' + 'token = token + "x"\n' * 20_000, "a." * 100_000 + "=", "x = `" * 40_000,
        'x = """' * 40_000, ("x = " + "'" * 3 + "\\") * 40_000, f'A = "{LITERAL * 5000}"\n' + "token = A\n" * 5000, "x = 'a'" + "\n " * 100_000, "'" + "a b " * 50_000, "a " * 100_000 + " " * 100_000,
    ):
        s.literal_spans(text)


def brute(text):
    """The base scan by its words, position by position."""
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0),
        ("hex", r"[0-9a-f]+", 32, 0),
    ):
        at = 0
        while m := re.compile(pattern, re.A).search(text, at):
            if len(m[group]) >= least:
                out.append((kind, m.start(), m.end()))
            at = m.end()
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_against_brute_force(spark):
    texts = [
        'x PassWord="abcdefgh" y', "api_key=short token = longenough1", "é𝄞 secret: abcdefghij", "AKIA" + "A" * 12 + " AKIAAKIA", "0123456789abcdef" * 2, "f" * 31, "f" * 33 + "g" + "0" * 40,
        "token=secret=abcdefgh", "ſecret=abcdefghi toKen=abcdefghi", "APIKEY : 'abc=def/ghi+'", "password='x' password='longenough'",
    ]
    rows = odd_rows() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in s.scan(frame(spark, rows)).collect())
    want = Counter()
    for r in rows:
        spans = brute(r[1] or "")
        kinds = Counter(k for k, _, _ in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[r[0], kinds["assign"], kinds["access"], kinds["hex"], digest] += 1
    assert got == want


def test_all_spans_hold_the_base(spark):
    text = f'password = "{LITERAL}" and AKIA{"B" * 16}'
    r = s.scan(frame(spark, [(1, text, "en", "a", 0)])).first()
    assert r.spans == "assign:0:28,literal:12:28,access:34:54"


def test_masking_keeps_rows_and_columns(spark):
    docs = frame(spark, [*odd_rows(), (50, f'a token = "{LITERAL}" b', "en", "a", 0)], clashing=True)
    clean = s.without_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("doc_id = 50").first().text == 'a [SECRET]" b'
    assert bag(clean.where("doc_id is null or doc_id <> 50")) == bag(docs.where("doc_id is null or doc_id <> 50"))
    assert s.scan(frame(spark, [])).collect() == [] and s.without_secrets(frame(spark, [])).collect() == []


@pytest.mark.parametrize(
    "part",
    [
        "password", "a", "a=", '"', "'a' + ", "a = (", "f(a=", "x = [", "x = 'a' or ", "<a>", "<a>b", "a, ", "a: |\n ", "x = `${a}", "a = b\n", "os.environ['a'] = ", "a = f('b', ", "a = ''.join([",
        "a = ('b'\n", "token = {'a': ", "x = a.b(c[", "&a ", "a: &b ", "((((",
    ],
)
def test_long_texts_take_time_in_proportion(part):
    def spent(n):
        text = part * n
        start = time.process_time()
        s.base_spans(text), s.literal_spans(text)
        return time.process_time() - start

    spent(100)
    few, many = min(spent(1_500) for _ in range(2)), spent(15_000)
    assert many < 45 * few + 0.5  # ten times the text; a hundred times the time if it were quadratic
