"""The shell, QML, ELF and JSON parsers, without Spark."""

import struct

import pytest

from lucerna.functions import binaries, jsonx, qml, shell
from lucerna.functions.paths import clean_path, cut_bytes


def calls(text):
    return [[w for w, _ in c.words] for n in shell.parse(text) for c in n.calls()]


def pipes(text):
    return [(shell.first_call(p.left).words[0][0], shell.first_call([p.right]).words[0][0]) for n in shell.parse(text) for p in n.pipes()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        ("# only a comment", []),
        ("x=1", []),
        ("a b 'c d' \"e f\"", [["a", "b", "c d", "e f"]]),
        ('eval "$x y"', [["eval", "<dynamic> y"]]),
        ("if [ -f x ]; then a; elif b; then c; else d; fi", [["[", "-f", "x", "]"], ["a"], ["b"], ["c"], ["d"]]),
        ("for i in 1 2; do a $i; done", [["a", "<dynamic>"]]),
        ("while a; do b; done", [["a"], ["b"]]),
        ("case $x in a|b) c;; *) d;; esac", [["c"], ["d"]]),
        ("f() { a; }; f", [["a"], ["f"]]),
        ("x=$(a | b) c", [["c"], ["a"], ["b"]]),
        ("a `b c`", [["a", "<dynamic>"], ["b", "c"]]),
        ("cat <<E\n$(a)\nE\nb", [["cat"], ["a"], ["b"]]),
        ("cat <<'E'\n$(a)\nE\nb", [["cat"], ["b"]]),
        ("[[ -f $(a) ]] && b", [["a"], ["b"]]),
        ("export A=$(a)", [["a"]]),
        ("! a; { b; } 2>&1; (c)", [["a"], ["b"], ["c"]]),
        ("a > x 2>/dev/null < y &", [["a"]]),
        ("echo a#b # c", [["echo", "a#b"]]),
        ("((i++)); a", [["a"]]),
        ("diff <(a) <(b)", [["diff", "<dynamic>", "<dynamic>"], ["a"], ["b"]]),
    ],
)
def test_commands(text, expected):
    assert calls(text) == expected


def test_pipes_group_from_the_left():
    assert pipes("curl a | tee b | bash") == [("curl", "bash"), ("curl", "tee")]
    assert pipes("echo a | curl b | bash")[0] == ("echo", "bash")
    assert pipes("a && b || c") == []


@pytest.mark.parametrize("text", ["if then", "fi", "a && || b", "echo 'x", 'echo "x', "echo $(a", "(a", "a )", "cat <<E\nx", "for do", "case x in a) b", "a | | b", "{ a"])
def test_malformed_shell_is_refused(text):
    with pytest.raises(shell.ShellSyntaxError):
        shell.parse(text)


def test_inline_program():
    find = lambda p: shell.pipes_into_interpreter(p, ("curl",), ("bash",))
    assert find("curl x | bash") and find("/usr/bin/curl x | /bin/bash -s")
    assert not find("echo 'curl x | bash'") and not find("curl x; bash") and not find("curl x | (") and not find("$c x | bash")


def test_qml():
    words = lambda t: [(c.words, c.dynamic) for c in qml.commands(t)]
    assert words('Process { command: ["a", "b\\n"] }') == [(["a", "b\n"], False)]
    assert words("Process { command: make() }") == [([], True)]
    assert words("Process { command: ['pkexec', helper] }") == [(["pkexec", "<dynamic>"], True)]
    assert words('// Process { command: ["a"] }') == [] and words('x: "Process { command: [1] }"') == []
    assert words("Process { Process { command: ['a'] } }") == [(["a"], False)]
    assert words("Process { command: []") == []
    assert qml.assigns_command("p.command = x") and not qml.assigns_command("p.command == x") and not qml.assigns_command("// p.command = x")
    assert qml.unquote('"\\q"') is None and qml.unquote("'ab'") == "ab" and qml.unquote('"\\u0041\\x42\\103"') == "ABC"


def test_elf_headers():
    header = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0)
    program = struct.pack("<IIQQQQQQ", 3, 0, 120, 0, 0, 8, 8, 1)
    found = binaries.elf(header + program + b"/lib/ld\0")
    assert (found["class"], found["machine"], found["type"], found["interpreter"], found["libraries"]) == ("ELFCLASS64", "EM_X86_64", "ET_EXEC", "/lib/ld", [])
    assert binaries.elf(b"\x7fELF") is None and binaries.elf(b"\x7fELF" + b"\xff" * 60) is None
    assert binaries.content_type(b"\x7fELFx") == "application/x-elf" and binaries.content_type(b"a\0") == "application/octet-stream"
    assert binaries.content_type(b" <html>") == "text/html; charset=utf-8" and binaries.content_type(b"") == "text/plain; charset=utf-8"


@pytest.mark.parametrize("data", [b'{"a":1,"a":2}', b'{"b":1}', b'{"A":1}', b'{"a":1}{}', b'{"a":"\\ud800"}', b"\xff", b"[1]", b'{"a":NaN}', b'{"a":' + b"[" * 70 + b"]" * 70 + b"}"])
def test_strict_json_refuses(data):
    with pytest.raises(jsonx.ReportError):
        jsonx.decode(data, {"a": None})


def test_strict_json_round_trip():
    assert jsonx.decode(b'{"a":{"x":"\\ud83d\\ude00"}}', {"a": {...: None}}) == {"a": {"x": "\U0001f600"}}
    assert jsonx.encode({"a": "<&>  é"}) == '{"a":"\\u003c\\u0026\\u003e\\u2028 é"}\n'
    assert jsonx.encoded_size("<") == 8
    with pytest.raises(jsonx.ReportError):
        jsonx.encode({"a": "x" * 100}, limit=50)


def test_paths():
    assert [clean_path(p) for p in ("a//b/", "./a", "a/../b", "", "//x")] == ["a/b", "a", "b", ".", "/x"]
    assert cut_bytes("é" * 300, 500) == "é" * 250 + "…" and cut_bytes("é" * 251, 501) == "é" * 250 + "…" and cut_bytes("abc", 3) == "abc"


def test_long_and_hostile_sources_take_linear_time():
    import time

    from lucerna.operators.extract import qml_facts, shell_facts

    begin = time.perf_counter()
    assert sum(1 for _ in shell_facts("rm a/b\n" * 100_000)) == 100_000
    assert list(qml_facts("Process {\n" * 100_000)) == []
    assert sum(1 for _ in qml_facts('Process { command: ["a"] }\n' * 40_000)) == 40_000
    last = list(shell_facts("rm a/b\n" * 1000))[-1]
    assert (last["line_start"], last["line_end"], last["excerpt"]) == (1000, 1000, "rm a/b")
    assert time.perf_counter() - begin < 60


def test_lines_and_flat_text():
    from lucerna.functions.texts import Lines, flat

    lines = Lines("a\nbb\n\nc")
    assert [lines.at(i) for i in range(7)] == [1, 1, 2, 2, 2, 3, 4]
    assert [lines.line(i, 9) for i in range(6)] == ["", "a", "bb", "", "c", ""] and lines.line(2, 1) == "b"
    assert flat("x  a \n b  y", 1, 9, 10) == "a b" and flat("a " * 50, 0, 100, 5).startswith("a a a") and len(flat("a " * 50, 0, 100, 5)) > 5
