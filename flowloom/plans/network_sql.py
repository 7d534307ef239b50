"""Networks written out as SQL over lists, for the oracle: an implementation of its own, from the same weights."""

from __future__ import annotations

import numpy as np

from flowloom.operators.inference import _ERFC


def literal(a: np.ndarray) -> str:
    return "[" + ", ".join(literal(x) if np.ndim(x) else f"{float(x)!r}::DOUBLE" for x in a) + "]"


def linear(x: str, w: np.ndarray, b: np.ndarray | None = None) -> str:
    """A list through a matrix (in, out)."""
    rows = literal(w.T)
    if b is None:
        return f"list_transform({rows}, lambda r: list_inner_product(r, {x}))"
    return f"list_transform(range(1, {w.shape[1] + 1}), lambda i: list_inner_product({rows}[i], {x}) + {literal(b)}[i])"


def gelu(x: str) -> str:
    """With the error function by the published coefficients."""
    t = "(1 / (1 + 0.5 * abs(v / sqrt(2))))"
    power = " + ".join(f"({c}) * pow({t}, {i})" for i, c in enumerate(_ERFC))
    return f"list_transform({x}, lambda v: 0.5 * v * (1 + sign(v) * (1 - {t} * exp({power} - v * v / 2))))"


def norm(x: str, scale: np.ndarray, shift: np.ndarray) -> str:
    mean = f"list_avg({x})"
    spread = f"sqrt(list_avg(list_transform({x}, lambda u: pow(u - {mean}, 2))) + 1e-5)"
    return f"list_transform(range(1, {len(scale) + 1}), lambda i: ({x}[i] - {mean}) / {spread} * {literal(scale)}[i] + {literal(shift)}[i])"


def softmax(x: str) -> str:
    return f"list_transform({x}, lambda v: exp(v - list_max({x})) / list_sum(list_transform({x}, lambda u: exp(u - list_max({x})))))"


def plus(x: str, y: str) -> str:
    return f"list_transform(range(1, len({x}) + 1), lambda i: {x}[i] + {y}[i])"


def steps(source: str, keep: str, *made: str, tag: str = "s") -> tuple[str, str]:
    """CTEs that make h from the last one's h, one after another, and the last one's name."""
    out, last = [], source
    for n, expression in enumerate(made):
        out.append(f"{tag}{n} AS MATERIALIZED (SELECT {keep}, {expression} AS h FROM {last})")
        last = f"{tag}{n}"
    return ", ".join(out), last


def slice_network(w: dict[str, np.ndarray], source: str) -> str:
    """CTEs of the network over ``source`` (sid, pid, h: a list of features); the last one is ``done`` (sid, pid, h)."""
    out = [f"e0 AS MATERIALIZED (SELECT sid, pid, {linear('h', w['pre_w1'], w['pre_b1'])} AS h FROM {source})", f"e1 AS MATERIALIZED (SELECT sid, pid, {gelu('h')} AS h FROM e0)"]
    out += [f"e2 AS MATERIALIZED (SELECT sid, pid, {linear('h', w['pre_w2'], w['pre_b2'])} AS h FROM e1)", f"h0 AS MATERIALIZED (SELECT sid, pid, {plus('h', literal(w['placeholder']))} AS h FROM e2)"]
    layers = sum(k.endswith("_heat") for k in w)
    for i in range(layers):
        p = {k[len(f"l{i}_") :]: v for k, v in w.items() if k.startswith(f"l{i}_")}
        heads, (d, slices) = len(p["heat"]), p["slice_w"].shape
        numbers = range(1, d + 1)
        add = lambda name, body: out.append(f"{name}{i} AS MATERIALIZED ({body})")  # noqa: E731,B023
        add("n", f"SELECT sid, pid, {norm('h', p['n1_scale'], p['n1_shift'])} AS h FROM h{i}")
        add("f", f"SELECT sid, pid, {linear('h', p['fx_w'], p['fx_b'])} AS fx, {linear('h', p['x_w'], p['x_b'])} AS xm FROM n{i}")
        add("a", f"SELECT sid, pid, hd, fx[hd * {d} + 1:hd * {d} + {d}] AS fx, xm[hd * {d} + 1:hd * {d} + {d}] AS h FROM f{i}, range({heads}) AS r(hd)")
        add("b", f"SELECT sid, pid, hd, fx, {linear('h', p['slice_w'], p['slice_b'])} AS h FROM a{i}")
        add("c", f"SELECT sid, pid, hd, fx, list_transform(h, lambda u: u / {literal(p['heat'])}[hd + 1]) AS h FROM b{i}")
        add("w", f"SELECT sid, pid, hd, fx, {softmax('h')} AS w FROM c{i}")
        add("t", f"SELECT sid, hd, g, [{', '.join(f'sum(w[g] * fx[{c}]) / (sum(w[g]) + 1e-5)' for c in numbers)}] AS h FROM w{i}, range(1, {slices + 1}) AS r(g) GROUP BY sid, hd, g")
        add("q", f"SELECT sid, hd, g, {linear('h', p['q'])} AS q, {linear('h', p['k'])} AS k, {linear('h', p['v'])} AS v FROM t{i}")
        add("s", f"SELECT a.sid, a.hd, a.g, b.v, list_inner_product(a.q, b.k) * {d ** -0.5!r} AS s FROM q{i} a JOIN q{i} b ON a.sid = b.sid AND a.hd = b.hd")
        add("x", f"SELECT sid, hd, g, v, exp(s - max(s) OVER (PARTITION BY sid, hd, g)) AS e FROM s{i}")
        add("o", f"SELECT sid, hd, g, [{', '.join(f'sum(e * v[{c}]) / sum(e)' for c in numbers)}] AS o FROM x{i} GROUP BY sid, hd, g")
        add("m", f"SELECT w.sid, w.pid, w.hd, [{', '.join(f'sum(w.w[o.g] * o.o[{c}])' for c in numbers)}] AS m FROM w{i} w JOIN o{i} o ON o.sid = w.sid AND o.hd = w.hd GROUP BY w.sid, w.pid, w.hd")
        add("j", f"SELECT sid, pid, flatten(list(m ORDER BY hd)) AS h FROM m{i} GROUP BY sid, pid")
        add("k", f"SELECT sid, pid, {linear('h', p['out_w'], p['out_b'])} AS h FROM j{i}")
        add("r", f"SELECT a.sid, a.pid, {plus('a.h', 'b.h')} AS h FROM k{i} a JOIN h{i} b ON a.sid = b.sid AND a.pid = b.pid")
        add("u", f"SELECT sid, pid, {norm('h', p['n2_scale'], p['n2_shift'])} AS h FROM r{i}")
        add("v", f"SELECT sid, pid, {linear('h', p['mlp_w1'], p['mlp_b1'])} AS h FROM u{i}")
        add("y", f"SELECT sid, pid, {gelu('h')} AS h FROM v{i}")
        add("z", f"SELECT sid, pid, {linear('h', p['mlp_w2'], p['mlp_b2'])} AS h FROM y{i}")
        out.append(f"h{i + 1} AS MATERIALIZED (SELECT a.sid, a.pid, {plus('a.h', 'b.h')} AS h FROM z{i} a JOIN r{i} b ON a.sid = b.sid AND a.pid = b.pid)")
    out.append(f"last AS MATERIALIZED (SELECT sid, pid, {norm('h', w['n3_scale'], w['n3_shift'])} AS h FROM h{layers})")
    return ", ".join([*out, f"done AS (SELECT sid, pid, {linear('h', w['head_w'], w['head_b'])} AS h FROM last)"])
