import io

import pytest

from textloom import cli


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "a.txt").write_text("alpha beta\nbeta gamma\n")
    (tmp_path / "b.txt").write_text("delta alpha\n")
    (tmp_path / "src/m.py").write_text("x = 'alpha'\nfoo123bar\n")
    (tmp_path / "skip.log").write_text("alpha\n")
    (tmp_path / ".ignore").write_text("*.log\n")
    (tmp_path / ".hid").write_text("alpha\n")
    (tmp_path / "n.bin").write_bytes(b"alpha\0")
    return str(tmp_path)


def call(spark, *argv):
    out = io.StringIO()
    code = cli.run(spark, list(argv), out)
    return code, out.getvalue().splitlines()


@pytest.mark.parametrize(
    ("flags", "want"),
    [
        (["-n", "alpha"], ["a.txt:1:alpha beta", "b.txt:delta alpha".replace(":", ":1:"), "src/m.py:1:x = 'alpha'"]),
        (["-c", "beta"], ["a.txt:2"]),
        (["--count-matches", "-I", "a"], ["6", "3", "3"]),
        (["-l", "alpha"], ["a.txt", "b.txt", "src/m.py"]),
        (["--files-without-match", "beta"], ["b.txt", "src/m.py"]),
        (["-o", "-n", "--column", "gam+a"], ["a.txt:2:6:gamma"]),
        (["--vimgrep", "-g", "*.py", "alpha"], ["src/m.py:1:6:x = 'alpha'"]),
        (["-tpy", "-r", "<$1>", r"foo(\d+)bar"], ["src/m.py:<123>"]),
        (["-v", "-e", "alpha", "-e", "foo"], ["a.txt:beta gamma"]),
        (["-i", "-F", "ALPHA BETA"], ["a.txt:alpha beta"]),
        (["-m1", "-I", "beta"], ["alpha beta"]),
        (["-u", "-l", "alpha"], ["a.txt", "b.txt", "skip.log", "src/m.py"]),
        (["-uuu", "-l", "alpha"], [".hid", "a.txt", "b.txt", "n.bin", "skip.log", "src/m.py"]),
        (["--files"], ["a.txt", "b.txt", "src/m.py"]),
        (["--sortr", "path", "-l", "alpha"], ["src/m.py", "b.txt", "a.txt"]),
        (["-n", "-A1", "-B0", "beta gam"], ["a.txt:2:beta gamma"]),
        (["nothing"], []),
        (["--heading", "-n", "beta"], ["a.txt", "1:alpha beta", "2:beta gamma"]),
        (["--heading", "-N", "alpha"], ["a.txt", "alpha beta", "", "b.txt", "delta alpha", "", "src/m.py", "x = 'alpha'"]),
        (["-n", "--field-match-separator", "=", "--field-context-separator", "\\t", "-A1", "alpha beta"], ["a.txt=1=alpha beta", "a.txt\t2\tbeta gamma"]),
        (["-I", "-v", "--context-separator", "~~", "-B0", "-e", "q"], ["alpha beta", "beta gamma", "delta alpha", "x = 'alpha'", "foo123bar"]),
        (["-I", "-H", "gamma"], ["a.txt:beta gamma"]),
        (["--column", "-b", "gamma"], ["a.txt:2:6:11:beta gamma"]),
        (["--color", "always", "-I", "gamma"], ["beta \x1b[0m\x1b[1;31mgamma\x1b[0m"]),
        (["--color=always", "--colors=match:none", "--colors=path:fg:blue", "gamma"], ["\x1b[0m\x1b[34ma.txt\x1b[0m:beta gamma"]),
        (["--color=never", "--hyperlink-format=file", "gamma"], ["a.txt:beta gamma"]),
        (["--binary", "-c", "alpha"], ["a.txt:1", "b.txt:1", "n.bin:1", "src/m.py:1"]),
        (["--binary", "alpha"], ["a.txt:alpha beta", "b.txt:delta alpha", 'n.bin: binary file matches (found "\\0" byte around offset 5)', "src/m.py:x = 'alpha'"]),
        (["--pre", "tr a-z A-Z <", "--pre-glob", "*.none", "gamma"], ["a.txt:beta gamma"]),
        (["--one-file-system", "--sort-files", "-l", "alpha"], ["a.txt", "b.txt", "src/m.py"]),
    ],
)
def test_output(spark, tree, flags, want):
    code, got = call(spark, *flags, tree)
    assert got == want and code == (0 if want else 1)


def test_errors_and_texts(spark, tree):
    assert call(spark, "(", tree)[0] == 2
    assert call(spark, "--nope", "x", tree)[0] == 2
    assert call(spark, "x", tree + "/none")[0] == 2
    assert call(spark, "--json", "-c", "x", tree)[0] == 2
    assert call(spark, "-q", "alpha", tree) == (0, [])
    assert call(spark, "--version")[0] == 0 and len(call(spark, "--type-list")[1]) == 213
    assert any('"type":"match"' in r for r in call(spark, "--json", "gamma", tree)[1])
    assert call(spark, "--stats", "gamma", tree)[1][1:3] == ["1 matches", "1 matched lines"]
    assert call(spark, "--stats", "gamma", tree)[1][-1] == "17 bytes printed"
    for bad in (["--color", "odd"], ["--colors", "match:fg:mauve"], ["--sort", "size"], ["--hyperlink-format", "{nope}", "--color=always"]):
        assert call(spark, *bad, "gamma", tree)[0] == 2
    assert len(call(spark, "--color=always", "--hyperlink-format=file", "gamma", tree)[1][0].split("\x1b]8;;")) == 3
    assert call(spark, "--sort", "created", "-l", "beta", tree) == call(spark, "--sortr", "accessed", "-l", "beta", tree) == (0, ["a.txt"])


def test_every_flag_parses():
    for name in cli.PLAIN:
        cli.parse([f"--{name}", "x"])
    for name in cli.VALUED:
        if name not in ("file",):
            cli.parse([f"--{name}", "1", "x"])
            cli.parse([f"--{name}=1", "x"])
    a = cli.parse(["-inC2", "-e", "p", "--crlf", "--null-data", "dir"])
    assert a.paths == ["dir"] and a.last("context") == "2" and "crlf" not in a.on and a.patterns == ["p"]
