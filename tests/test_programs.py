"""Programs run over small logs, as columns and row by row."""

import random

import pytest

BOTH = pytest.mark.parametrize("tier", [None, "C"])


@BOTH
def test_histograms(play, tier):
    program = "histogram a buckets 1, 2, 4, 8\nhistogram b buckets -1, 0, 1\nhistogram c by x buckets 1, 2\n/^(.) (\\d+)/ {\n  a = $2\n  b = $2\n  c[$1] = $2\n}\n"
    cells, errors, _ = play(program, "b 3\nb 3\nb 3\nb 0\n", tier)
    assert errors == 0
    assert cells["a", ()] == ([1, 0, 3, 0, 0], 4, 9.0)
    assert cells["b", ()] == ([1, 0, 3], 4, 9.0)
    assert cells["c", ("b",)] == ([1, 0, 3], 4, 9.0)


@BOTH
def test_parse_a_hyphen_is_an_error(play, tier):
    cells, errors, _ = play('counter total\n/^[a-z]+ ((?P<n>\\d+)|-)$/ {\n  $n > 0 {\n    total = $n\n  }\n}\n', "size 41\nsize -\n", tier)
    assert cells["total", ()] == 41 and errors == 1


@BOTH
def test_parse_around_a_hyphen(play, tier):
    cells, errors, _ = play('counter total\n/^[a-z]+ ((?P<n>\\d+)|-)$/ {\n  $1 != "-" {\n    total = $n\n  }\n}\n', "size 41\nsize -\n", tier)
    assert cells["total", ()] == 41 and errors == 0


@BOTH
@pytest.mark.parametrize("inner,outer", [("} else {", "} else {"), ("}\notherwise {", "}\notherwise {")])
def test_else_and_otherwise(play, tier, inner, outer):
    program = f"counter yes\ncounter maybe\ncounter no\n/1/ {{\n  /^1$/ {{\n    yes++\n  {inner}\n    maybe++\n  }}\n{outer}\n  no++\n}}\n"
    cells, _, _ = play(program, "1\n7\n31\n8\n6\n100\n", tier)
    assert cells == {("yes", ()): 1, ("maybe", ()): 2, ("no", ()): 3}


@BOTH
def test_types_come_from_captures(play, tier):
    program = "gauge i\ngauge f\ngauge fm by l\ngauge im by l\ncounter p\n/^(\\d+)$/ {\n  i = $1\n  im[$1] = $1\n  p += 1.0 * $1\n}\n/^(\\d+\\.\\d+)$/ {\n  f = $1\n  fm[$1] = $1\n}\n"
    cells, _, _ = play(program, "58\n3.25\n009\n", tier)
    assert cells["i", ()] == 9 and cells["f", ()] == 3.25 and cells["p", ()] == 67.0
    assert cells["fm", ("3.25",)] == 3.25 and cells["im", ("58",)] == 58 and cells["im", ("9",)] == 9


@BOTH
def test_logical_operators_and_decorators(play, tier):
    program = 'counter some\ncounter last\ncounter sep\ndef d {\n  /(?P<x>...).*/ {\n    next\n  }\n}\n@d {\n  $x == "Sep" {\n    sep++\n  }\n}\n/(?P<var>.*)/ {\n  $var == "red" || $var == "blue" {\n    some++\n  }\n  $var == "blue" && 1 == 1 {\n    last++\n  }\n}\n'
    cells, errors, _ = play(program, "red\nred\nblue\nblue\ngreen\nSep\nSep\n", tier)
    assert cells == {("some", ()): 4, ("last", ()): 2, ("sep", ()): 2} and errors == 0


@BOTH
def test_typed_comparison(play, tier):
    program = 'counter t by le\ncounter t_sum\n/^(?P<v>\\d+(\\.\\d+)?)/ {\n  $v < 0.5 {\n    t["0.5"]++\n  }\n  $v < 1 {\n    t["1"]++\n  }\n  t["inf"]++\n  t_sum += $v\n}\n'
    cells, _, _ = play(program, "0.1\n1\n1.765\n", tier)
    assert cells["t", ("0.5",)] == 1 and cells["t", ("1",)] == 1 and cells["t", ("inf",)] == 3
    assert cells["t_sum", ()] == pytest.approx(2.865)


@BOTH
def test_strings(play, tier):
    program = 'counter f by s\ngauge bytes by d\ntext ip\ntext all\ncounter v by r\n/^(.*), (.*)$/ {\n  f[$1 + $2]++\n}\n/sent (?P<n>[\\d,]+)/ {\n  bytes["s"] += int(subst(",", "", $n))\n}\n/ip (\\d+\\.\\d+\\.\\d+\\.\\d+)/ {\n  ip = $1\n}\n/^([a-z])$/ {\n  all += $1\n}\n/GET (?P<u>\\S+)/ {\n  v[subst(/\\d+/, ":num", $u)]++\n}\n'
    cells, errors, _ = play(program, "a, b\nc, d\nsent 7,301,444 x\nip 10.0.7.200\np\nq\nGET /item/81/edit\n", tier)
    assert errors == 0
    assert cells["f", ("ab",)] == 1 and cells["f", ("cd",)] == 1 and cells["bytes", ("s",)] == 7301444
    assert cells["ip", ()] == "10.0.7.200" and cells["all", ()] == "pq" and cells["v", ("/item/:num/edit",)] == 1


@BOTH
def test_arithmetic(play, tier):
    program = "gauge g by k\n/^(-?\\d+) (-?\\d+)$/ {\n" + "".join(f'  g["{op}"] = $1 {op} $2\n' for op in ("+", "-", "*", "&", "|", "^", "**", "/", "%")) + "}\n"
    cells, errors, _ = play(program, "-7 2\n", tier)
    assert {k[1][0]: v for k, v in cells.items()} == {"+": -5, "-": -9, "*": -14, "&": 0, "|": -5, "^": -5, "**": 49, "/": -3, "%": -1}
    cells, errors, _ = play(program, "9223372036854775807 2\n5 0\n", tier)
    assert errors == 1 and cells["g", ("+",)] == 5
    cells, _, _ = play("gauge a\ngauge b\n/^(-?\\d+) (-?\\d+)$/ {\n  a = $1 + $2\n  b = $1 * $2\n}\n", "9223372036854775807 2\n", tier)
    assert cells["a", ()] == -9223372036854775807 and cells["b", ()] == -2


@BOTH
def test_shifts(play, tier):
    cells, errors, _ = play("gauge l by n\ngauge r by n\n/^(-?\\d+) (-?\\d+)$/ {\n  r[$2] = $1 >> $2\n  l[$2] = $1 << $2\n}\n", "-8 1\n-8 64\n-8 -1\n", tier)
    assert cells["r", ("1",)] == -4 and cells["l", ("1",)] == -16 and cells["r", ("64",)] == -1 and cells["l", ("64",)] == 0 and errors == 1
    assert cells["r", ("-1",)] == 0  # the cell is made before its value fails


@BOTH
def test_times(play, tier):
    program = 'gauge t by k\n/^(?P<d>\\w+ +\\d+ [\\d:]+) a$/ {\n  strptime($d, "Jan _2 15:04:05")\n  t["a"] = timestamp()\n}\n/^(?P<d>.*) b$/ {\n  strptime($d, "02/Jan/2006:15:04:05 -0700")\n  t["b"] = timestamp()\n}\n/c/ {\n  t["c"] = timestamp()\n}\n'
    cells, errors, _ = play(program, "Jun  3 12:04:43 a\n10/Oct/2000:13:55:36 -0700 b\nnope b\nc\n", tier)
    assert cells["t", ("a",)] == 1717416283 and cells["t", ("b",)] == 971211336 and cells["t", ("c",)] == 1704067200 and errors == 1


@BOTH
def test_set_inc_and_delete(play, tier):
    program = "gauge g by k\n/^inc (.)x$/ {\n  g[$1]++\n}\n/^set (.)x (\\d+)$/ {\n  g[$1] = $2\n}\n/^del (.)x$/ {\n  del g[$1]\n}\n/^dec (.)x$/ {\n  g[$1]--\n}\n"
    cells, _, _ = play(program, "inc ax\nset ax 10\ninc ax\ninc bx\ninc bx\ndel bx\ninc bx\ninc cx\ndel cx\ndec dx\n", tier)
    assert cells == {("g", ("a",)): 11, ("g", ("b",)): 1, ("g", ("d",)): -1}


@BOTH
def test_loose_comparison(play, tier):
    program = 'counter c by k\n/^(.*)$/ {\n  tolower($1) == "abc" {\n    c["eq"]++\n  }\n  c["n"]++\n}\n'
    cells, errors, _ = play(program, "ABC\n10\nx\n", tier)
    assert cells == {("c", ("eq",)): 1, ("c", ("n",)): 2} and errors == 1


@BOTH
def test_captures_of_patterns_that_did_not_match(play, tier):
    cells, errors, _ = play("counter c by k\n/a(.)x/ || /b/ {\n  c[$1]++\n}\n", "aqx\nb\n", tier)
    assert cells == {("c", ("q",)): 1} and errors == 1


def test_feedback(play):
    program = "gauge t\ncounter hit\ncounter miss\n/seconds = (?P<s>\\d+)/ {\n  t = $s * 1000\n  t < 100000 {\n    hit++\n  } else {\n    miss++\n  }\n}\n"
    cells, _, result = play(program, "seconds = 100\nseconds = 200\nseconds = 50\n")
    assert cells == {("t", ()): 50000, ("hit", ()): 1, ("miss", ()): 2} and result.tiers == {"p": "C"}
    cells, _, _ = play("text s\ncounter b by f\n/(.*)/ {\n  s = $1\n}\n/b/ {\n  b[s]++\n}\n", "1.1\nc\nb\na\n")
    assert cells == {("s", ()): "a", ("b", ("b",)): 1}
    cells, _, _ = play("gauge avg\n/(\\d+)/ {\n  avg = 0.9 * $1 + 0.1 * avg\n}\n", "10\n20\n")
    assert cells["avg", ()] == pytest.approx(18.9)


def test_sessions_by_key(play):
    program = 'hidden gauge opened by pid\ncounter spent\n/^(?P<t>\\d+) \\[(?P<pid>\\d+)\\] (?P<what>\\w+)$/ {\n  settime($t)\n  $what == "open" {\n    opened[$pid] = timestamp()\n  }\n  $what == "close" {\n    spent += timestamp() - opened[$pid]\n    del opened[$pid]\n  }\n}\n'
    cells, errors, result = play(program, "10 [1] open\n12 [2] open\n15 [1] close\n20 [2] close\n30 [3] close\n")
    assert cells["spent", ()] == 5 + 8 + 30 and errors == 0
    assert not any(k[0] == "opened" for k in cells)


@pytest.mark.parametrize("key", ["pid", ""])
def test_feedback_goes_on_from_a_former_store(spark, key):
    import datetime as dt

    from metricloom.api import Options, run
    from metricloom.sources.lines import from_text

    cell = "last[$pid]" if key else "last"
    program = f"gauge last{' by pid' if key else ''}\ncounter up by pid\n/^(?P<pid>\\d+) (?P<v>\\d+)$/ {{\n  $v > {cell} {{\n    up[$pid]++\n  }}\n  {cell} = $v\n}}\n"
    options, log = Options(now=dt.datetime(2024, 1, 1, tzinfo=dt.UTC)), "1 5\n2 7\n1 6\n2 3\n1 9\n2 4\n"
    shown = lambda r: sorted(map(str, r.store.select("name", "labels", "int_value").collect()))
    whole = run(from_text(spark, log), {"p": program}, options)
    first = run(from_text(spark, log[:12]), {"p": program}, options)
    second = run(from_text(spark, log[12:]), {"p": program}, options, first.store)
    assert whole.tiers == {"p": "C"} and shown(whole) == shown(second)


def test_multi_line_records(play):
    program = 'hidden text user\ncounter slow by user\n/^# User: (\\w+)$/ {\n  user = $1\n}\nuser == "" {\n  stop\n}\n/^SELECT/ {\n  slow[user]++\n  user = ""\n}\n'
    cells, _, _ = play(program, "SELECT 0\n# User: ann\nSELECT 1\nSELECT 2\n# User: bob\nSELECT 3\n")
    assert {k: v for k, v in cells.items() if k[0] == "slow"} == {("slow", ("ann",)): 1, ("slow", ("bob",)): 1}


def test_expiry_of_a_missing_cell(play):
    _, errors, _ = play("gauge g by k\n/^s (.)x/ {\n  g[$1] = 1\n}\n/^e (.)x/ {\n  del g[$1] after 1h\n}\n", "s ax\ne ax\ne bx\n")
    assert errors == 1


def test_filename_and_many_programs(play):
    cells, _, result = play({"a": "counter n by f\n/$/ {\n  n[getfilename()]++\n}\n", "b": "counter m\n/x/ {\n  m++\n}\n"}, "x\ny\n", filename="/var/log/x")
    assert cells == {("n", ("/var/log/x",)): 2, ("m", ()): 1} and result.tiers == {"a": "A", "b": "A"}


def test_a_name_has_one_kind(play):
    from metricloom.store import LoadError

    with pytest.raises(LoadError):
        play({"a": "counter n\n/x/ {\n  n++\n}\n", "b": "gauge n\n/x/ {\n  n = 1\n}\n"}, "x\n")


def _random_program(r: random.Random) -> str:
    def effect(depth):
        return "  " * depth + r.choice(['c[$1]++', 'c[$1] += $2', 'g[$1] = $2', 'g[$1]++', 'h = $2', 'f += 0.5 * $2', 't[$1] = $1 + "x"', 'del g[$1]', 'g[$1] = 100 / $2', 'c[$1] += int($3)', "c[string($2 % 3)]--", "stop"]) + "\n"

    def block(depth):
        out = ""
        for _ in range(r.randint(1, 3)):
            if depth < 4 and r.random() < 0.5:
                cond = r.choice(["$2 > 3", "$2 == 0", '$1 == "a"', "/b/", '$1 =~ /[ab]/', '$3 !~ /^\\d/', "$2 < 8 && /c/", '/a/ || $2 >= 5', "($2 & 1) == 1", "$2 / ($2 - 4) > 0"])
                out += "  " * depth + f"{cond} {{\n{block(depth + 1)}" + "  " * depth + "}" + (f" else {{\n{block(depth + 1)}" + "  " * depth + "}" if r.random() < 0.4 else "") + "\n"
                if r.random() < 0.3:
                    out += "  " * depth + f"otherwise {{\n{block(depth + 1)}" + "  " * depth + "}\n"
            else:
                out += effect(depth)
        return out

    body = block(1)
    heads = {"c": "counter c by k\n", "g": "gauge g by k\n", "h": "histogram h buckets 1, 3, 6\n", "f": "gauge f\n", "t": "text t by k\n"}
    used = "".join(v for k, v in heads.items() if f"{k}[" in body or f"{k} =" in body or f"{k} +=" in body)
    return used + "/^(\\w+) (\\d+) (\\S+)$/ {\n" + body + "}\n"


def test_columns_agree_with_row_by_row(play):
    """Random programs: the columns of tiers A and B against the interpreter."""
    r = random.Random(7)
    log = "".join(f"{r.choice('abc')}{r.choice('abc') * r.randint(0, 1)} {r.randint(0, 9)} {r.choice(['17', 'x', '-', '3b'])}\n" for _ in range(60))
    for _ in range(12):
        program = _random_program(r)
        assert play(program, log)[:2] == play(program, log, "C")[:2], program


@BOTH
def test_sums_wrap(play, tier):
    """Increments add up in 64 bits, as one addition does; sets come before what is added after them."""
    top = str((1 << 63) - 1)
    cells, errors, _ = play("counter c\ngauge g\n/^(-?\\d+)$/ {\n  c += $1\n  g += $1\n}\n/^set (-?\\d+)$/ {\n  g = $1\n}\n", f"{top}\n2\nset {top}\n5\n-1\n{top}\n-{top}\n", tier)
    wrap = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    assert errors == 0 and cells[("c", ())] == wrap(int(top) + 6) and cells[("g", ())] == wrap(int(top) + 4)
