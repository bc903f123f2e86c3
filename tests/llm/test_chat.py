from __future__ import annotations

import hashlib
import pickle
import random

import pytest

from mailfleet.llm.chat import TEMPLATE, Reading, format_turns, read_back
from mailfleet.llm.template import Template, TemplateError

ROWS = "conv_id bigint, turn bigint, role string, text string, part string, _index int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], ROWS)


def rendered(source, messages, controls=()):
    return Template(source, controls).conversation(messages)


CHAT = [("system", "S"), ("user", " hi "), ("assistant", "yes")]


@pytest.mark.parametrize("source, want", [
    ("a{{ 'b' ~ 1 + 2 }}c", "ab12c"),
    ("{{ 1 + 2 }}", "3"),
    ("{% for m in messages %}{{ m.role }}={{ m['text'] | trim | upper }};{% endfor %}end", "system=S;user=HI;assistant=YES;end"),
    ("{% for m in messages %}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{{ loop.index }}/{{ loop.length }}{% endfor %}", "<1/3-2/3>3/3"),
    ("{% for m in messages %}{% set x = m.role ~ '!' %}{% if 'us' in x and not loop.last %}{{ x }}{% endif %}{% endfor %}", "user!"),
    ("{# note #}{% if false or none %}no{% else %}{{ \"q\\n\" }}{% endif %}", "q\n"),
    ("{% for m in messages %}{{ m.text | length }}{{ m.role == 'user' }}{% endfor %}", "1False4True3False"),
])
def test_language(source, want):
    assert rendered(source, CHAT)[0] == want


def test_constants_are_folded():
    template = Template("a{{ 'x' | upper }}{% if 1 < 2 %}b{% else %}{{ 'never' }}{% endif %}{{ 2 + 3 }}")
    assert template.has_head and not template.has_tail and template.head() == ("aXb5", [])
    assert not Template("{% for m in messages %}{% if false %}{{ loop.first }}{% endif %}{% endfor %}").needs_position


@pytest.mark.parametrize("source", [
    "{{ messages }}", "{{ x }}", "{{ m.role }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ ''.join }}",
    "{% for m in messages %}", "{% if 1 %}", "{{ 'a' | eval }}", "{{ print('x') }}", "{% import os %}", "{{ 'a }}", "{{ 1 2 }}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% set loop = 1 %}", "{% endif %}",
    "{% for m in messages %}{{ m.role.text }}{% endfor %}", "{% if 1 %}{% for m in messages %}{% endfor %}{% endif %}",
])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_spans_cover_what_is_learned():
    text, spans = rendered("<s>{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}!{% endgeneration %}{% else %}{{ m.text }}{% endif %}{% endfor %}", CHAT * 2)
    assert [text[a:b] for a, b in spans] == ["yes!", "yes!"]
    assert pickle.loads(pickle.dumps(TEMPLATE)).message("user", "a\\") == TEMPLATE.message("user", "a\\")


def test_escapes_are_reversible():
    rng = random.Random(4)
    bits = ["\\", "### ", "###", "</turn>", "</turn", "<", ": ", ":", " ", "\n", "a", "é", "</turn>\n"]
    for _ in range(3000):
        chat = [("".join(rng.choices(bits, k=rng.randint(0, 6))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(3)]
        text, _ = TEMPLATE.conversation(chat)
        reading = Reading()
        while text:  # in pieces that cut anywhere
            n = rng.randint(1, 25)
            reading.feed(text[:n], [])
            text = text[n:]
        assert reading.result()[:2] == (3, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in chat).encode()).hexdigest()), chat


def test_odd_rows(spark):
    long = "word: </turn> " * 40_000
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", None), (1, None, None, "first"), (2, 5, "assistant", long),
            (None, 0, "assistant", "lost"), (None, 1, "user", "x"), (3, 0, "assistant", ""), (4, 7, "b", "y"), (4, 7, "b", "x"), (4, 7, "a", "z"), (4, 7, "a", "z")]
    got = {r.conv_id: r for r in read_back(format_turns(turns_of(spark, rows))).collect()}
    assert len(got) == 5
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nfirst\nuser\n\nassistant\nsecond\n") and got[1].loss_sha256 == sha("second")
    assert got[2].loss_sha256 == sha(long) and got[2].loss_chars == len(long)
    assert got[None].n_turns == 2 and got[None].loss_chars == 4
    assert got[3].loss_sha256 == sha("") and got[3].n_turns == 1
    assert got[4].n_turns == 4 and got[4].turns_sha256 in {sha("a\nz\n" * 2 + f"b\n{p}\nb\n{q}\n") for p, q in ("xy", "yx")}
    assert read_back(format_turns(turns_of(spark, []))).count() == 0


def test_places_head_and_tail(spark):
    template = Template("<s>{% for m in messages %}[{{ loop.index }}/{{ loop.length }}{{ m.text }}{% if loop.last %}.{% endif %}]{% endfor %}</s>")
    rows = [(c, t * 100, "user", f"{t}") for c in (1, None) for t in range(12)] + [(2, 0, "user", "")]
    parts = format_turns(turns_of(spark, rows).repartition(4), template).collect()
    for conv in (1, 2, None):
        own = sorted((r for r in parts if r.conv_id == conv), key=lambda r: (r.part, r.turn or 0))
        assert "".join(r.text for r in own) == template.conversation([("user", r[3]) for r in rows if r[0] == conv])[0]
