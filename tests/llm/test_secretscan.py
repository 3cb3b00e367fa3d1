import random
import re
import time

import pytest

from sonolith.llm import secretscan

KINDS = {"assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0), "hex": (r"[0-9a-f]+", 0)}


def slow(text):
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return sorted((m.start(), list(KINDS).index(k), m.end()) for k, (p, f) in KINDS.items() for m in re.finditer(p, text, f) if ok[k](m))


TEXTS = [
    "", None, "password: hunter22 token='abc' SECRET=abcdef0123", "key AKIA" + "A1B2" * 4 + " AKIA12", "0123456789abcdef" * 3 + " deadbeef",
    "x = 'q9Zt7Lp2Xv81'\nauth_token = x\npublic_key_id = 'q9Zt7Lp2Xv81'", 'tokentoken = "é" api-key api_key:=zzzzzzz ſecret=abcdefg', "password=token=secret=abc123",
    '{"client_secret": "Zx81-qwe!RTY", "name": "Zx81-qwe!RTY"}', "export DB_PASSPHRASE=corR3ct-h0rse", "note: the password is long",
]


def test_base_spans():
    for t in TEXTS:
        assert secretscan.base_spans(t or "") == slow(t or "")


def test_method_adds_and_keeps(docs):
    got = {x.doc_id: x.spans for x in secretscan.scan(docs(list(enumerate(TEXTS)))).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        assert [(s.start, secretscan.KINDS.index(s.kind), s.end) for s in got[k] if s.kind != "lexed"] == slow(t or "")
    lexed = lambda k: [TEXTS[k][s.start : s.end] for s in got[k] if s.kind == "lexed"]
    assert lexed(5) == ["q9Zt7Lp2Xv81"]  # through the constant x, not the public id
    assert lexed(8) == ["Zx81-qwe!RTY"] or any(s.kind == "assign" for s in got[8])
    assert lexed(9) == ["corR3ct-h0rse"]
    assert lexed(10) == [] and got[0] == [] and got[1] == []


V = "q9Zt7Lp2Xv81"
LEXED = {
    "x = 'q9Zt7Lp2Xv81'\nauth_token = x\npublic_key_id = 'q9Zt7Lp2Xv81'": [V],
    "export DB_PASSPHRASE=corR3ct-h0rse": ["corR3ct-h0rse"],
    "# note: password = \"q9Zt7Lp2Xv81\"": [V],
    "db_password: str = \"q9Zt7Lp2Xv81\"": [V],
    "db_password: Optional[str] = 'q9Zt7Lp2Xv81'": [V],
    "db_password = 'q9Zt7' + 'Lp2Xv81'": ["q9Zt7' + 'Lp2Xv81"],
    "db_password = (\n  'q9Zt7'\n  'Lp2Xv81'\n)": ["q9Zt7'\n  'Lp2Xv81"],
    "K=q9Zt7Lp2Xv81\nDB_PASSPHRASE=$K": [V],
    "K=q9Zt7Lp2Xv81\nDB_PASSPHRASE=\"a${K}b\"": ["a${K}b"],
    "a='q9Zt7'\nb='Lp2Xv81'\npassphrase=a+b": ["q9Zt7"],
    "const privateKey = `q9Zt7Lp2Xv81`;": [V],
    'pw = os.environ["DB_PASSWORD"]': [],
    'db_secretx = f("q9Zt7Lp2Xv81")': [],
    'os.environ["DB_PASSPHRASE"] = "q9Zt7Lp2Xv81"': [V],
    "<dbpass><password>q9Zt7Lp2Xv81</password></dbpass>": [V],
    '<add key="DbPassword" value="q9Zt7Lp2Xv81"/>': [V],
    "creds:\n  passphrase: |\n    q9Zt7Lp2\n    Xv81aa\n  other: 1": ["q9Zt7Lp2\n    Xv81aa"],
    ":passphrase => 'q9Zt7Lp2Xv81', x: 1": [V],
    "a = b_passphrase = 'q9Zt7Lp2Xv81'": [V],
    "passphrase=abc:def123XYZ9": ["abc:def123XYZ9"],
    "if passphrase == 'q9Zt7Lp2Xv81':": [],
    "passphrase != 'q9Zt7Lp2Xv81'": [],
    "passphrase = q9Zt7Lp2Xv8=": ["q9Zt7Lp2Xv8="],
    "it was: the passphrase of old": [],
    "passphrase: see below": [],
    "$passphrase = 'q9Zt7' . 'Lp2Xv81';": ["q9Zt7' . 'Lp2Xv81"],
    "run --passphrase=q9Zt7Lp2Xv81 now": [V],
}


@pytest.mark.parametrize("text", LEXED)
def test_pairs(text):
    assert [text[s:e] for s, e, _, _ in secretscan.lexed(text)] == LEXED[text]


def test_planted_among_other_statements():
    """Every planted literal is found whatever stands around it, and nothing else."""
    r = random.Random(9)
    sign = lambda k: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHJKLMNPQRST23456789") for _ in range(k))
    shapes = ["{n} = '{v}'", "{n}: \"{v}\"", "export {n}={v}", '  "{n}": "{v}",', "<{n}>{v}</{n}>", "let {n} = `{v}`;", "'{n}' => '{v}'", "x, y = 1, 2 # {n} = '{v}'"]
    noise = ["", "for k in range(9): pass", "a == b != c", "title: a plain sentence, nothing more", "f(x=1, y=[2, 3])", "{", "}", "it's \"odd", "path = '/usr/lib/x'", "count: 12345678901"]
    for _ in range(60):
        want, lines = [], []
        for _ in range(30):
            lines.append(r.choice(noise))
            if r.random() < 0.3:
                want.append(sign(r.randrange(14, 30)))
                lines.append(r.choice(shapes).format(n=r.choice(["db_passphrase", "clientSecret", "AUTH_TOKEN", "api_key"]), v=want[-1]))
        text = "\n".join(lines)
        assert sorted(text[s:e] for s, e, _, _ in secretscan.lexed(text)) == sorted(want)


@pytest.mark.parametrize("part", ["a.-9", "a=", "token=", '\\"', "x=`", "<a ", "x='\"`", "a=+", "x=(", "token=(\n", "token=a+\n", ":", "token: |\n ", "a=a+a\n", '"'])
def test_time_in_proportion(part):
    """Twenty times the text takes no more than some sixty times as long."""
    took = []
    for size in (20_000, 400_000):
        text = "token=" + part * (size // len(part))
        began = time.perf_counter()
        list(secretscan.lexed(text))
        secretscan.base_spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * max(took[0], 0.01)


def test_empty_table(docs):
    assert secretscan.scan(docs([])).count() == 0
