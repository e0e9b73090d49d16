"""Scripts with loops over a batch: as each row by itself, and in time."""

import time

import numpy as np
import pandas as pd
import pytest

from lodestone.operators import relevance as R

ROWS = pd.DataFrame({
    "n": np.array([0, 3, 50, 7, -2], np.int32), "x": [0.5, float("nan"), -3.0, 1e300, 2.0], "name": ["red", "blue", "", None, "red"],
    "tags": [["a", "b"], [], ["b"], np.array(["c", "a", "b"], object), None], "flag": [True, False, True, True, False],
})
SCRIPTS = [
    "double s = 0; for (int i = 1; i <= n; i++) { s += i; } return s;",
    "int s = 1; while (s < n) { s = s * 3; if (s > 20) return s / 2; } return s;",
    "double s = 0; do { s += 0.5; } while (s < n); return s / 2;",
    "int k = 0; for (String t : tags) { if (t.equals(\"b\")) k += 10; else k++; } return k;",
    "int k = 7; for (int i = 0; i < n; i++) { if (i % 2 == 0) k += 0.5; } return k / 2;",
    "for (int i = 0; i < n; i++) { if (words.contains(name) && i > 1) return m.get(name); } return n > 5 ? x : 1.5;",
    "int s = 1; for (int i = 0; i < n; i++) { s = s * 17; } return s;",
    "for (int i = 0; i < 3; i++) { if (n != 0 && 12 / n > i) return Math.exp(n / 10.0) + Math.max(n, i); }",
    "for (int i = 0; i < 2; i++) { if (flag) { int z = i; } } return flag ? z : -1;",
    "int t = n; for (int i = 0; i < 2; i++) { t -= (int) (n * 0.3); n = 5; } return Math.abs(t) + n;",
    "for (int i = 0; i < 2; i++) { if (!(x > 0) || 1 / n > 5) return i; } return (double) n;",
    "while (n < 100) { n += 0; } return 1;",
]


def by_row(body, plain):
    out = []
    for row in ROWS.to_dict("records"):
        got = R.Interpreter().run(body, {**plain, **{k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in row.items()}})
        out.append(float(got) if got is not None else None)
    return pd.Series(out, dtype="float64")


@pytest.mark.parametrize("script", SCRIPTS)
def test_batches_score_as_rows(script, monkeypatch):
    monkeypatch.setattr(R, "LOOP_LIMIT", 1000)
    body, plain = R.Script(script).body, {"words": ["red"], "m": {"red": 4}}
    if SCRIPTS.index(script) in (0, 1, 2, 3, 5, 7, 8, 9):  # none of these needs single rows
        own = by_row(body, plain)
        monkeypatch.setattr(R.Interpreter, "run", lambda *a: pytest.fail("row by row"))
        pd.testing.assert_series_equal(R.scores(ROWS, body, plain), own, check_exact=True)
        return
    try:
        want = by_row(body, plain)
    except Exception as e:
        with pytest.raises(type(e)):
            R.scores(ROWS, body, plain)
        return
    pd.testing.assert_series_equal(R.scores(ROWS, body, plain), want, check_exact=True)


def test_loops_run_over_whole_batches(monkeypatch):
    body = R.Script(SCRIPTS[0]).body
    n = np.arange(200_000, dtype=np.int32) % 50 + 1
    monkeypatch.setattr(R.Interpreter, "run", lambda *a: pytest.fail("row by row"))
    began = time.time()
    got = R.scores(pd.DataFrame({"n": n}), body, {})
    assert (got.to_numpy() == n * (n + 1) / 2).all() and time.time() - began < 20
