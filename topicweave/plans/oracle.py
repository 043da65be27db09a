"""The registered queries as SQL, written independently of the Spark operators.

Models are unrolled: one common table expression per iteration, one column per
topic. Each statement starts from the raw tables.
"""

from __future__ import annotations

from contextlib import contextmanager

from topicweave.functions import text as tx
from topicweave.functions.wordlists import (
    EMOTICONS,
    PUNCTUATION,
    cleaning_stop_words,
    query_stop_words,
)
from topicweave.operators.factors import EPSILON, TINY
from topicweave.operators.projected import BETA, ENOUGH, TRIALS, TURNS
from topicweave.operators.search import SEARCH_ITERATIONS, TOP_HITS
from topicweave.operators.sentences import ALWAYS, AROUND, LEAST_SCORE
from topicweave.plans.queries import (
    ACCOUNTS,
    EM_ITERATIONS,
    EXAMPLE_TOPICS,
    K,
    MANY_TOPICS,
    NEWEST,
    NMF_ITERATIONS,
    SEARCH_TEXT,
    STRANGER,
)

Z = range(K)
EPS = f"{EPSILON!r}::double"
FLOOR = f"{TINY!r}::double"
SEARCH_THRESHOLD = 1e-3
LANCZOS_STEPS = 24


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


@contextmanager
def _topics(k: int):
    """Statements written inside have k topics."""
    global Z
    before, Z = Z, range(k)
    try:
        yield
    finally:
        Z = before


def _cols(fn, sep: str = ", ") -> str:
    return sep.join(fn(z) for z in Z)


def _sum(fn) -> str:
    return "(" + _cols(fn, " + ") + ")"


# --- text ---------------------------------------------------------------------


def _tokens(text: str) -> str:
    """Word tokens of a text, by rules over the whole text."""
    sql = f"regexp_replace(' ' || coalesce({text}, '') || ' ', {_quote(tx.WHITE_SPACE)}, '  ', 'g')"
    for pattern, replacement in tx.TOKEN_RULES:
        sql = f"regexp_replace({sql}, {_quote(pattern)}, {_quote(replacement.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex(trim({sql}), ' +'), lambda t: t <> '')"


STOP = f"list_contains({_list(cleaning_stop_words())}, lower(t))"
EMOTICON = f"list_contains({_list(EMOTICONS)}, t)"
PUNCT = f"contains({_quote(PUNCTUATION)}, t)"
LINK = f"starts_with(t, {_quote(tx.SHORT_LINK_PREFIX)})"


def _kept(tokens: str, drop: str) -> str:
    return f"array_to_string(list_filter({tokens}, lambda t: NOT ({drop})), ' ')"


def _clean(text: str) -> str:
    return _kept(_tokens(text), f"{STOP} OR {EMOTICON} OR {PUNCT} OR {LINK}")


def _query_words(text: str) -> str:
    words = f"string_split_regex(trim(regexp_replace({text}, {_quote(tx.WHITE_SPACE)}, ' ', 'g')), ' ')"
    stop = f"list_contains({_list(query_stop_words())}, w)"
    kept = f"list_filter({words}, lambda w: w <> '' AND NOT {stop})"
    return f"list_distinct(list_transform({kept}, lambda w: lower(w)))"


# --- building blocks as common table expressions --------------------------------


def _with(*ctes: str, tail: str) -> str:
    parts = [c for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n" + tail


def _cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


CORPUS = _cte(
    "corpus", "SELECT doc_id, text AS full_text, source AS screen_name FROM documents"
)
CELLS = ",\n".join(
    [
        CORPUS,
        _cte("cleaned", f"SELECT doc_id, {_clean('full_text')} AS edited_text FROM corpus"),
        _cte(
            "cells",
            "SELECT word, doc_id, count(*)::double AS n FROM (SELECT doc_id, unnest("
            f"regexp_extract_all(lower(edited_text), {_quote(tx.COUNTED_TOKEN)})) AS word FROM cleaned)"
            " GROUP BY word, doc_id",
        ),
        _cte("vocab", "SELECT DISTINCT word FROM cells"),
        _cte("docs", "SELECT DISTINCT doc_id FROM corpus"),
        _cte("size", "SELECT sum(n) AS total FROM cells"),
    ]
)


def _seed(prefix: str, key: str, z: int) -> str:
    digest = f"md5({_quote(prefix)} || {key} || ':{z // 4}')"
    return f"((('0x' || substr({digest}, {1 + 8 * (z % 4)}, 8))::bigint::double + 1) / 4294967296.0)"


def _seeds(prefix: str, table: str, key: str, out: str) -> str:
    values = _cols(lambda z: f"{_seed(prefix, key + '::varchar', z)} AS u{z}")
    return _cte(out, f"SELECT {key}, {values} FROM {table}")


def _em_start() -> str:
    """w0, d0 (normalised, floored) and z0 from hashed values."""

    def part(raw: str, key: str, out: str) -> str:
        total = _cols(lambda z: f"sum(u{z}) AS t{z}")
        shares = _cols(lambda z: f"greatest(u{z} / t{z}, {EPS}) AS p{z}")
        return _cte(out, f"SELECT {key}, {shares} FROM {raw}, (SELECT {total} FROM {raw})")

    prior = _cols(lambda z: f"u{z} / {_sum(lambda y: f'u{y}')} AS p{z}")
    return ",\n".join(
        [
            _seeds("w", "vocab", "word", "ws"),
            _seeds("d", "docs", "doc_id", "ds"),
            part("ws", "word", "w0"),
            part("ds", "doc_id", "d0"),
            _cte("zs", "SELECT " + _cols(lambda z: f"{_seed('z', _quote(''), z)} AS u{z}")),
            _cte("z0", f"SELECT {prior} FROM zs"),
        ]
    )


def _em_step(i: int, cells: str = "cells", docs: str = "docs") -> str:
    prod = lambda z: f"z{i}.p{z} * w{i}.p{z} * d{i}.p{z}"
    shares = _cols(lambda z: f"n * {prod(z)} / den AS r{z}")
    joined = (
        f"SELECT c.*, {_cols(lambda z: f'{prod(z)} AS x{z}')} FROM {cells} c"
        f" JOIN w{i} USING (word) JOIN d{i} USING (doc_id), z{i}"
    )
    shares = _cols(lambda z: f"n * x{z} / {_sum(lambda y: f'x{y}')} AS r{z}")
    mass = _cols(lambda z: f"sum(r{z}) AS m{z}")
    word = _cols(lambda z: f"greatest(sum(r{z}) / any_value(m{z}), {EPS}) AS p{z}")
    doc = _cols(lambda z: f"greatest(coalesce(sum(r{z}), 0) / any_value(m{z}), {EPS}) AS p{z}")
    prior = _cols(lambda z: f"m{z} / {_sum(lambda y: f'm{y}')} AS p{z}")
    j = i + 1
    return ",\n".join(
        [
            _cte(f"r{j}", f"SELECT word, doc_id, {shares} FROM ({joined})"),
            _cte(f"m{j}", f"SELECT {mass} FROM r{j}"),
            _cte(f"w{j}", f"SELECT word, {word} FROM r{j}, m{j} GROUP BY word"),
            _cte(
                f"d{j}",
                f"SELECT doc_id, {doc} FROM {docs} LEFT JOIN r{j} USING (doc_id), m{j} GROUP BY doc_id",
            ),
            _cte(f"z{j}", f"SELECT {prior} FROM m{j}"),
        ]
    )


def _em(iterations: int = EM_ITERATIONS, start: str | None = None, **tables: str) -> str:
    steps = [_em_step(i, **tables) for i in range(iterations)]
    return ",\n".join([start or _em_start(), *steps])


def _unpivot(table: str, key: str, digits: int = 10, side: str | None = None) -> str:
    label = f"{_quote(side)} AS side, {key}::varchar AS item" if side else key
    return " UNION ALL ".join(
        f"SELECT {label}, {z}::int AS z, round(p{z}, {digits}) AS p FROM {table}" for z in Z
    )


def _stacked(words: str, docs: str) -> str:
    return (
        _unpivot(words, "word", side="word") + " UNION ALL " + _unpivot(docs, "doc_id", side="doc")
    )


N_EM = EM_ITERATIONS
MODEL = f"{CELLS},\n{_em()}"
LAST_W, LAST_D, LAST_Z = f"w{N_EM}", f"d{N_EM}", f"z{N_EM}"


# --- factorisation --------------------------------------------------------------


def _nmf_start(scaled: bool = True, prefixes: tuple[str, str] = ("w", "d")) -> str:
    """W0, H0 with columns p0.. from hashed values."""
    scale = "1.0"
    if scaled:
        scale = (
            "(2.0::double * sqrt(1.0::double / ((SELECT count(*) FROM vocab)"
            f" * (SELECT count(*) FROM docs) * {K})))"
        )

    def part(prefix: str, table: str, key: str, out: str) -> str:
        raw = f"{out}s"
        values = _cols(lambda z: f"greatest(u{z} * s, {FLOOR}) AS p{z}")
        return (
            _seeds(prefix, table, key, raw)
            + ",\n"
            + _cte(out, f"SELECT {key}, {values} FROM {raw}, (SELECT {scale} AS s)")
        )

    return (
        part(prefixes[0], "vocab", "word", "fw0") + ",\n" + part(prefixes[1], "docs", "doc_id", "fh0")
    )


def _sides(side: str) -> tuple[str, str]:
    return ("word", "doc_id") if side == "W" else ("doc_id", "word")


def _kl_half(side: str, mine: str, other: str, out: str) -> str:
    key, _ = _sides(side)
    w, h = (mine, other) if side == "W" else (other, mine)
    inner = (
        f"SELECT c.word, c.doc_id, n / (SELECT total FROM size) AS x,"
        f" {_cols(lambda z: f'w.p{z} * h.p{z} AS x{z}')}"
        f" FROM cells c JOIN {w} w USING (word) JOIN {h} h USING (doc_id)"
    )
    sums = _cols(lambda z: f"sum(x * x{z} / {_sum(lambda y: f'x{y}')}) AS s{z}")
    mass = _cols(lambda z: f"sum(p{z}) AS m{z}")
    new = _cols(
        lambda z: f"greatest(coalesce(s{z}, 0) / greatest(m{z}, {FLOOR}), {FLOOR}) AS p{z}"
    )
    return ",\n".join(
        [
            _cte(f"{out}_s", f"SELECT {key}, {sums} FROM ({inner}) GROUP BY {key}"),
            _cte(f"{out}_m", f"SELECT {mass} FROM {other}"),
            _cte(
                out,
                f"SELECT {key}, {new} FROM (SELECT {key} FROM {mine}) LEFT JOIN {out}_s"
                f" USING ({key}), {out}_m",
            ),
        ]
    )


def _square_half(side: str, mine: str, other: str, out: str, update: str) -> str:
    key, other_key = _sides(side)
    sums = _cols(lambda z: f"sum(n / (SELECT total FROM size) * o.p{z}) AS s{z}")
    pairs = [(i, j) for i in Z for j in Z]
    grams = ", ".join(f"sum(p{i} * p{j}) AS g{i}_{j}" for i, j in pairs)
    base = ", ".join(
        [key]
        + [f"p{z}" for z in Z]
        + [f"coalesce(s{z}, 0) AS s{z}" for z in Z]
        + [f"g{i}_{j}" for i, j in pairs]
    )
    rows = f"SELECT {base} FROM {mine} LEFT JOIN {out}_s USING ({key}), {out}_g"
    dot = lambda names, z: "(" + " + ".join(f"{names[j]} * g{j}_{z}" for j in Z) + ")"
    old = [f"p{z}" for z in Z]
    keep = ", ".join([f"s{z}" for z in Z] + [f"g{i}_{j}" for i, j in pairs])
    ctes: list[str] = []
    if update == "mu":
        new = _cols(
            lambda z: f"greatest(p{z} * s{z} / greatest({dot(old, z)}, {FLOOR}), {FLOOR}) AS q{z}"
        )
        body = f"SELECT {key}, {new} FROM ({rows})"
    elif update == "hals":
        for z in Z:
            step = f"p{z} + (s{z} - {dot(old, z)}) / greatest(g{z}_{z}, {FLOOR})"
            carried = ", ".join([key] + [f"p{y}" for y in Z if y != z])
            rows = f"SELECT {carried}, {keep}, greatest({step}, {FLOOR}) AS p{z} FROM ({rows})"
        body = f"SELECT {key}, {_cols(lambda z: f'p{z} AS q{z}')} FROM ({rows})"
    else:
        ctes, body = _least_squares(rows, key, out)
    return ",\n".join(
        [
            _cte(
                f"{out}_s",
                f"SELECT {key}, {sums} FROM cells JOIN {other} o USING ({other_key}) GROUP BY {key}",
            ),
            _cte(f"{out}_g", f"SELECT {grams} FROM {other}"),
            *ctes,
            _cte(out, f"SELECT {key}, {_cols(lambda z: f'q{z} AS p{z}')} FROM ({body})"),
        ]
    )


def _least_squares(rows: str, key: str, out: str) -> tuple[list[str], str]:
    """Non-negative least squares by trying every passive set: the best feasible solution wins.

    The inverse of a set's Gram matrix follows from that of the set without its last topic.
    """
    ctes = [_cte(f"{out}_b", rows)]
    solutions = [
        f"SELECT {key}, 0.0::double AS value, [{', '.join(['0.0::double'] * K)}] AS x FROM {out}_b"
    ]
    for bits in range(1, 1 << K):
        own = [z for z in Z if bits >> z & 1]
        before, m = own[:-1], own[-1]
        parent = sum(1 << z for z in before)
        # u = inverse x column, rest = what the column adds of its own
        u = {z: "(" + (" + ".join(f"i.v{z}_{j} * g{j}_{m}" for j in before) or "0") + ")" for z in before}
        rest = f"(g{m}_{m} - ({' + '.join(f'g{z}_{m} * {u[z]}' for z in before) or '0'}))"
        values = [f"i.v{x}_{y} + {u[x]} * {u[y]} / {rest} AS v{x}_{y}" for x in before for y in before]
        values += [f"-{u[x]} / {rest} AS v{x}_{m}, -{u[x]} / {rest} AS v{m}_{x}" for x in before]
        values.append(f"1.0::double / {rest} AS v{m}_{m}")
        source = f"{out}_g" + (f", {out}_i{parent} i" if before else "")
        ctes.append(_cte(f"{out}_i{bits}", f"SELECT {', '.join(values)} FROM {source}"))
        x = [
            "(" + " + ".join(f"i.v{z}_{j} * b.s{j}" for j in own) + ")" if z in own else "0.0::double"
            for z in Z
        ]
        solutions.append(
            f"SELECT {key}, {' + '.join(f'x[{z + 1}] * s{z}' for z in own)} AS value, x FROM"
            f" (SELECT b.*, [{', '.join(x)}] AS x FROM {out}_b b, {out}_i{bits} i) WHERE list_min(x) >= 0"
        )
    best = f"SELECT {key}, arg_max(x, value) AS x FROM ({' UNION ALL '.join(solutions)}) GROUP BY {key}"
    body = f"SELECT {key}, {_cols(lambda z: f'greatest(x[{int(z) + 1}], {FLOOR}) AS q{z}')} FROM ({best})"
    return ctes, body


def _gradient(z: int) -> str:
    return "(" + " + ".join(f"p{j} * g{j}_{z}" for j in Z) + f" - s{z})"


def _searched_rows(side: str, mine: str, other: str, out: str) -> list[str]:
    """{out}_r0: factor rows with their products; {out}_g: the other side's Gram matrix."""
    key, other_key = _sides(side)
    sums = _cols(lambda z: f"sum(n / (SELECT total FROM size) * o.p{z}) AS s{z}")
    grams = ", ".join(f"sum(p{i} * p{j}) AS g{i}_{j}" for i in Z for j in Z)
    held = _cols(lambda z: f"p{z}, coalesce(s{z}, 0) AS s{z}")
    return [
        _cte(
            f"{out}_s",
            f"SELECT {key}, {sums} FROM cells JOIN {other} o USING ({other_key}) GROUP BY {key}",
        ),
        _cte(f"{out}_g", f"SELECT {grams} FROM {other}"),
        _cte(f"{out}_r0", f"SELECT {key}, {held} FROM {mine} LEFT JOIN {out}_s USING ({key})"),
    ]


def _search_half(side: str, mine: str, other: str, out: str, limit: str) -> str:
    """A side by projected gradient with a line search; {out}_a10 holds how it went.

    Every turn sums slope and curvature for all step lengths it may take, ascending.
    """
    key, _ = _sides(side)
    first, beta = TRIALS - 1, BETA
    steps = [f"alpha / {beta**n!r}" for n in range(first, 0, -1)]
    steps += [f"alpha * {beta**n!r}" for n in range(TRIALS)]
    parts = _searched_rows(side, mine, other, out)
    parts.append(
        _cte(
            f"{out}_a0",
            f"SELECT 1.0::double AS alpha, false AS ended, 0 AS turns, 0.0::double AS square, 0.0::double AS step",
        )
    )
    for t in range(TURNS):
        grads = _cols(lambda z: f"{_gradient(int(z))} AS d{z}")
        keep = _cols(lambda z: f"p{z}, s{z}")
        parts.append(_cte(f"{out}_d{t}", f"SELECT {key}, {keep}, {grads} FROM {out}_r{t}, {out}_g"))
        free = _sum(lambda z: f"sum(CASE WHEN d{z} < 0 OR p{z} > {FLOOR} THEN d{z} * d{z} ELSE 0 END)")
        tried = (
            f"SELECT unnest([{', '.join(steps)}]) AS a, unnest([0.0::double, {', '.join(steps[:-1])}]) AS b,"
            f" unnest(range(1, {len(steps) + 1})) AS j FROM {out}_a{t}"
        )
        moves = _cols(lambda z: f"greatest(p{z} - a * d{z}, {FLOOR}) - p{z} AS m{z}")
        changed = _sum(
            lambda z: f"(greatest(p{z} - a * d{z}, {FLOOR}) <> greatest(p{z} - b * d{z}, {FLOOR}))::int"
        )
        slope = _sum(lambda z: f"d{z} * m{z}")
        bend = " + ".join(f"m{i} * g{i}_{j} * m{j}" for i in Z for j in Z)
        parts.append(
            _cte(
                f"{out}_t{t}",
                f"SELECT list({1 - ENOUGH!r}::double * slope + 0.5::double * bend < 0 ORDER BY j) AS e,"
                f" list(moved ORDER BY j) AS m FROM (SELECT j, sum({slope}) AS slope, sum({bend}) AS bend,"
                f" sum({changed}) AS moved FROM (SELECT *, {moves} FROM {out}_d{t}, ({tried})), {out}_g GROUP BY j)",
            )
        )
        up = [
            (f"NOT e[{first + 1 + n}] OR m[{first + 1 + n}] = 0", f"alpha * {beta ** (n - 1)!r}", f"alpha * {beta**n!r}")
            for n in range(1, TRIALS)
        ]
        down = [(f"e[{first + 1 - n}]", f"alpha / {beta**n!r}", f"alpha / {beta**n!r}") for n in range(1, TRIALS)]

        def chosen(which: int, more: str, less: str) -> str:
            longer = " ".join(f"WHEN {c[0]} THEN {c[which]}" for c in up)
            shorter = " ".join(f"WHEN {c[0]} THEN {c[which]}" for c in down)
            return (
                f"CASE WHEN e[{first + 1}] THEN CASE {longer} ELSE {more} END"
                f" ELSE CASE {shorter} ELSE {less} END END"
            )

        step = chosen(1, f"alpha * {beta**first!r}", "0.0")
        following = chosen(2, f"alpha * {beta**TRIALS!r}", f"alpha / {beta**TRIALS!r}")
        parts.append(
            _cte(
                f"{out}_a{t + 1}",
                f"SELECT CASE WHEN over THEN alpha ELSE {following} END AS alpha, over AS ended,"
                " turns + CASE WHEN over THEN 0 ELSE 1 END AS turns,"
                " CASE WHEN ended THEN square ELSE now END AS square,"
                f" CASE WHEN over THEN 0.0 ELSE {step} END AS step FROM (SELECT *,"
                f" ended OR sqrt(now) < ({limit}) AS over FROM {out}_a{t}, {out}_t{t},"
                f" (SELECT {free} AS now FROM {out}_d{t}))",
            )
        )
        new = _cols(lambda z: f"greatest(p{z} - step * d{z}, {FLOOR}) AS p{z}, s{z}")
        parts.append(_cte(f"{out}_r{t + 1}", f"SELECT {key}, {new} FROM {out}_d{t}, {out}_a{t + 1}"))
    parts.append(_cte(out, f"SELECT {key}, {_cols(lambda z: f'p{z}')} FROM {out}_r{TURNS}"))
    return ",\n".join(parts)


def _nmf_searched(tag: str = "f") -> str:
    """Projected gradient with a line search, words first. The sides' limits start at a
    thousandth of the first gradient and fall tenfold when a side has nothing to do."""
    parts = [_nmf_start(), *_searched_rows("W", "fw0", "fh0", "bw"), *_searched_rows("H", "fh0", "fw0", "bh")]
    square = _sum(lambda z: f"{_gradient(int(z))} * {_gradient(int(z))}")
    both = " + ".join(f"(SELECT sum({square}) FROM {x}_r0, {x}_g)" for x in ("bw", "bh"))
    parts.append(_cte("first", f"SELECT sqrt({both}) AS norm"))
    now = {"W": "fw0", "H": "fh0"}
    limit = {side: "SELECT 0.001::double * norm FROM first" for side in "WH"}
    for i in range(1, NMF_ITERATIONS + 1):
        for side in "WH":
            out = f"{tag}{side.lower()}{i}"
            parts.append(_search_half(side, now[side], now["H" if side == "W" else "W"], out, limit[side]))
            parts.append(
                _cte(
                    f"{out}_l",
                    f"SELECT ({limit[side]}) / CASE WHEN turns = 0 THEN 10.0::double ELSE 1.0::double END"
                    f" AS l FROM {out}_a{TURNS}",
                )
            )
            limit[side] = f"SELECT l FROM {out}_l"
            now[side] = out
    return ",\n".join(parts)


def _nmf(update: str, order: str, start: str | None = None, tag: str = "f") -> str:
    parts = [part for part in [_nmf_start() if start is None else start] if part]
    now = {"W": "fw0", "H": "fh0"}
    for i in range(1, NMF_ITERATIONS + 1):
        for side in order:
            other = now["H" if side == "W" else "W"]
            out = f"{tag}{side.lower()}{i}"
            if update == "kl":
                parts.append(_kl_half(side, now[side], other, out))
            else:
                parts.append(_square_half(side, now[side], other, out, update))
            now[side] = out
    return ",\n".join(parts)


def _to_plsa(w: str, h: str, tag: str = "n") -> str:
    """{tag}w, {tag}d with unit sums per topic and {tag}z."""

    def divided(table: str, key: str, out: str) -> str:
        total = _cols(lambda z: f"sum(p{z}) AS t{z}")
        return _cte(
            out,
            f"SELECT {key}, {_cols(lambda z: f'p{z} / t{z} AS p{z}')}"
            f" FROM {table}, (SELECT {total} FROM {table})",
        )

    mass = _cols(lambda z: f"(SELECT sum(p{z}) FROM {w}) * (SELECT sum(p{z}) FROM {h}) AS m{z}")
    prior = _cols(lambda z: f"m{z} / {_sum(lambda y: f'm{y}')} AS p{z}")
    return ",\n".join(
        [
            divided(w, "word", f"{tag}w"),
            divided(h, "doc_id", f"{tag}d"),
            _cte(f"{tag}z", f"SELECT {prior} FROM (SELECT {mass})"),
        ]
    )


def _residual_row(method: str, iteration: int, w: str, h: str, tag: str) -> tuple[str, str]:
    """CTEs and one row (method, iter, kl, frobenius, kkt_w, kkt_h) for factors w, h."""
    model = _sum(lambda z: f"w.p{z} * h.p{z}")
    cells = _cte(
        f"{tag}_c",
        f"SELECT c.word, c.doc_id, n / (SELECT total FROM size) AS x, {model} AS model,"
        f" {_cols(lambda z: f'w.p{z} AS a{z}')}, {_cols(lambda z: f'h.p{z} AS b{z}')}"
        f" FROM cells c JOIN {w} w USING (word) JOIN {h} h USING (doc_id)",
    )
    sums = _cte(
        f"{tag}_t",
        f"SELECT * FROM (SELECT {_cols(lambda z: f'sum(p{z}) AS cw{z}')} FROM {w}),"
        f" (SELECT {_cols(lambda z: f'sum(p{z}) AS rh{z}')} FROM {h})",
    )
    by_word = _cols(lambda z: f"sum(x / model * b{z}) AS v{z}")
    by_doc = _cols(lambda z: f"sum(x / model * a{z}) AS v{z}")
    kw = _sum(lambda z: f"abs(least(p{z}, rh{z} - coalesce(v{z}, 0)))")
    kh = _sum(lambda z: f"abs(least(p{z}, cw{z} - coalesce(v{z}, 0)))")
    cross = " + ".join(
        f"(SELECT sum(p{i} * p{j}) FROM {w}) * (SELECT sum(p{i} * p{j}) FROM {h})"
        for i in Z
        for j in Z
    )
    row = (
        f"SELECT {_quote(method)} AS method, {iteration}::int AS iter,"
        f" round((SELECT sum(x * ln(x / model)) - sum(x) FROM {tag}_c)"
        f" + (SELECT {_sum(lambda z: f'cw{z} * rh{z}')} FROM {tag}_t), 8) AS kl,"
        f" round(sqrt(greatest((SELECT sum(x * x - 2 * x * model) FROM {tag}_c) + {cross}, 0)), 8)"
        " AS frobenius,"
        f" round((SELECT sum({kw}) FROM {w} LEFT JOIN (SELECT word, {by_word} FROM {tag}_c GROUP BY word)"
        f" USING (word), {tag}_t), 4) AS kkt_w,"
        f" round((SELECT sum({kh}) FROM {h} LEFT JOIN (SELECT doc_id, {by_doc} FROM {tag}_c GROUP BY doc_id)"
        f" USING (doc_id), {tag}_t), 4) AS kkt_h"
    )
    return f"{cells},\n{sums}", row


def _em_weighted(i: int, tag: str) -> str:
    values = _cols(lambda z: f"w.p{z} * z.p{z} AS p{z}")
    return _cte(f"{tag}_a", f"SELECT w.word, {values} FROM w{i} w, z{i} z")


def _em_residuals(iterations: list[int], tag: str = "e") -> tuple[list[str], list[str]]:
    ctes, rows = [], []
    for i in iterations:
        name = f"{tag}{i}"
        more, row = _residual_row("EM", i, f"{name}_a", f"d{i}", name)
        ctes += [_em_weighted(i, name), more]
        rows.append(row)
    return ctes, rows


# --- singular values ------------------------------------------------------------


def _lanczos(steps: int = LANCZOS_STEPS) -> str:
    """l0..: orthonormal vectors over the documents, one at a time; tri: the tridiagonal matrix.

    A vector's image is made orthogonal to all vectors before it, twice.
    """
    parts = [
        _cte(
            "x0",
            "SELECT doc_id, (doc_id * 7919 % 1009)::double / 1009 - 0.5 AS x FROM (SELECT DISTINCT doc_id FROM cells)",
        ),
        _cte("l0", "SELECT doc_id, x / (SELECT sqrt(sum(x * x)) FROM x0) AS x FROM x0"),
    ]
    for j in range(steps):
        known = " UNION ALL ".join(f"SELECT {i} AS i, doc_id, x FROM l{i}" for i in range(j + 1))
        image = (
            f"SELECT doc_id, sum(n / (SELECT total FROM size) * y) AS x FROM cells JOIN (SELECT word,"
            f" sum(n / (SELECT total FROM size) * x) AS y FROM cells JOIN l{j} USING (doc_id) GROUP BY word)"
            " USING (word) GROUP BY doc_id"
        )
        parts += [_cte(f"k{j}", known), _cte(f"i{j}_0", image)]
        for turn in (1, 2):
            before = f"i{j}_{turn - 1}"
            share = f"SELECT i, sum(k.x * b.x) AS c FROM k{j} k JOIN {before} b USING (doc_id) GROUP BY i"
            own = f"SELECT doc_id, sum(k.x * c) AS y FROM k{j} k JOIN ({share}) USING (i) GROUP BY doc_id"
            parts.append(
                _cte(f"i{j}_{turn}", f"SELECT b.doc_id, b.x - y AS x FROM {before} b JOIN ({own}) USING (doc_id)")
            )
        parts.append(
            _cte(
                f"t{j}",
                f"SELECT (SELECT sum(b.x * l.x) FROM i{j}_0 b JOIN l{j} l USING (doc_id)) AS a,"
                f" (SELECT sqrt(sum(x * x)) FROM i{j}_2) AS b",
            )
        )
        parts.append(_cte(f"l{j + 1}", f"SELECT doc_id, x / (SELECT b FROM t{j}) AS x FROM i{j}_2"))
    rows = " UNION ALL ".join(
        f"SELECT {j} AS j, a, {f'(SELECT b * b FROM t{j - 1})' if j else '0.0::double'} AS b FROM t{j}"
        for j in range(steps)
    )
    parts.append(_cte("tri", rows))
    return ",\n".join(parts)


def _spectrum(k: int) -> str:
    """The k largest singular values by bisection: the signs of the pivots of the tridiagonal
    matrix less x count the values below x."""
    pivot = "(v.a - middle) - v.b / CASE WHEN acc.q = 0 THEN 1e-300 ELSE acc.q END"
    below = (
        "list_reduce(all_rows, lambda acc, v: {'a': v.a, 'b': v.b, "
        f"'q': {pivot}, 'n': acc.n + CASE WHEN {pivot} < 0 THEN 1 ELSE 0 END}}).n"
    )
    rows = (
        "SELECT list_prepend({'a': 0.0::double, 'b': 0.0::double, 'q': 1.0::double, 'n': 0},"
        " list({'a': a, 'b': b, 'q': 0.0::double, 'n': 0} ORDER BY j)) AS all_rows FROM tri"
    )
    return (
        "SELECT i, round(sqrt(low), 12) AS sigma FROM ("
        "WITH RECURSIVE held AS MATERIALIZED (" + rows + "), halved AS ("
        f" SELECT unnest(range(0, {k}))::int AS i, 0.0::double AS low,"
        " (SELECT 2 * (max(a) + 2 * sqrt(max(b))) FROM tri) AS high, 0 AS turn"
        " UNION ALL SELECT i, CASE WHEN keep THEN middle ELSE low END, CASE WHEN keep THEN high ELSE middle END,"
        f" turn + 1 FROM (SELECT *, {below} <= {LANCZOS_STEPS} - 1 - i AS keep"
        " FROM (SELECT *, (low + high) / 2 AS middle FROM halved, held WHERE turn < 80))"
        ") SELECT i, low FROM halved WHERE turn = 80)"
    )


# --- statements -----------------------------------------------------------------


def _ranked_docs(source: str, where: str = "") -> str:
    return (
        "SELECT z, rank, doc_id, p, screen_name, full_text FROM (SELECT *, (row_number() OVER"
        f" (PARTITION BY z ORDER BY p DESC, doc_id))::INT AS rank FROM ({source}) {where})"
        " JOIN corpus USING (doc_id) WHERE rank <= 5"
    )


def _long_docs() -> str:
    return _unpivot(LAST_D, "doc_id", 9)


def _fold(queries: str, oov: bool = False, smooth: bool = False) -> str:
    """q0..qn: topic shares of the queries ``(query_id, query)``; qa: their words with weight n.
    With ``oov`` a query without a known word has all words alike, with ``smooth`` every query
    has all words, those it doesn't hold at 1e-12."""
    values = _cols(lambda z: f"greatest(w.p{z}, {FLOOR}) * z.p{z} AS a{z}")
    words = f"SELECT query_id, 1.0::double AS n, {values} FROM terms JOIN {LAST_W} w USING (word), {LAST_Z} z"
    if oov:
        words += (
            f" UNION ALL SELECT query_id, 1.0::double AS n, {values} FROM asked, {LAST_W} w, {LAST_Z} z"
            f" WHERE query_id NOT IN (SELECT query_id FROM terms JOIN {LAST_W} USING (word))"
        )
    if smooth:
        words = (
            f"SELECT a.query_id, CASE WHEN t.word IS NULL THEN {FLOOR} ELSE 1.0::double END AS n, {values}"
            f" FROM (SELECT DISTINCT query_id FROM asked) a CROSS JOIN {LAST_W} w CROSS JOIN {LAST_Z} z"
            " LEFT JOIN terms t ON t.word = w.word AND t.query_id = a.query_id"
        )
    parts = [
        _cte("asked", queries),
        _cte("terms", f"SELECT query_id, unnest({_query_words('query')}) AS word FROM asked"),
        _cte("qa", words),
        _cte(
            "q0",
            "SELECT query_id, (count(*) FILTER (n = 1))::int AS matched, "
            + _cols(lambda z: f"{1.0 / K!r}::double AS q{z}")
            + " FROM qa GROUP BY query_id",
        ),
    ]
    for i in range(SEARCH_ITERATIONS):
        den = _sum(lambda z: f"a{z} * q{z}")
        sums = _cols(lambda z: f"sum(n * a{z} * q{z} / {den}) AS s{z}")
        new = _cols(lambda z: f"greatest(s{z} / {_sum(lambda y: f's{y}')}, {FLOOR}) AS q{z}")
        parts.append(
            _cte(
                f"q{i + 1}",
                f"SELECT query_id, matched, {new} FROM (SELECT query_id, matched, {sums}"
                f" FROM qa JOIN q{i} USING (query_id) GROUP BY query_id, matched)",
            )
        )
    return ",\n".join(parts)


def _long_shares(queries: str, smooth: bool = False) -> str:
    tail = " UNION ALL ".join(
        f"SELECT query_id, matched, {z}::int AS z, round(q{z}, 8) AS q FROM q{SEARCH_ITERATIONS}" for z in Z
    )
    return _with(MODEL, _fold(queries, smooth=smooth), tail=tail)


def _hits(queries: str, oov: bool = False, smooth: bool = False) -> str:
    score = _sum(lambda z: f"q{z} * p{z}")
    return _with(
        MODEL,
        _fold(queries, oov, smooth),
        tail="SELECT query_id, rank, doc_id, score, screen_name, full_text FROM (SELECT *,"
        " (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank"
        f" FROM (SELECT query_id, doc_id, round({score}, 9) AS score FROM q{SEARCH_ITERATIONS},"
        f" {LAST_D} WHERE {score} > {SEARCH_THRESHOLD!r}::double)) JOIN corpus USING (doc_id)"
        f" WHERE rank <= {TOP_HITS}",
    )


def _newest(accounts: list[str] | None) -> str:
    where = f" WHERE screen_name IN ({', '.join(map(_quote, accounts))})" if accounts else ""
    return (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY screen_name"
        f" ORDER BY doc_id DESC) AS rn FROM corpus{where}) WHERE rn <= {NEWEST}"
    )


def _abbreviations() -> str:
    words = f"unnest(string_split(regexp_replace(coalesce(text, ''), {_quote(tx.WHITE_SPACE)}, ' ', 'g'), ' '))"
    bare = f"lower(regexp_replace(raw, {_quote(AROUND)}, '', 'g'))"
    inner = "(length(word) - length(replace(word, '.', '')))"
    letters = f"(length(word) - {inner})"
    return (
        f"WITH bare AS (SELECT {bare} AS bare FROM (SELECT {words} AS raw FROM documents)), typed AS ("
        " SELECT bare, ends_with(bare, '.') AND NOT ends_with(bare, '..') AS stop FROM bare"
        r" WHERE regexp_matches(bare, '\p{L}')), counts AS MATERIALIZED ("
        " SELECT CASE WHEN stop THEN left(bare, length(bare) - 1) ELSE bare END AS word,"
        " sum(stop::int)::bigint AS stops, sum(1 - stop::int)::bigint AS plain FROM typed GROUP BY 1),"
        " share AS (SELECT least(sum(stops) / sum(stops + plain), 1 - 1e-9) AS p FROM counts)"
        " SELECT word, stops, plain, round(score, 6) AS score FROM (SELECT word, stops, plain,"
        f" 2 * (stops * ln({ALWAYS!r}::double) + plain * ln(1 - {ALWAYS!r}::double) - stops * ln(p)"
        f" - plain * ln(1 - p)) * exp(-{letters}) * ({inner} + 1) * pow({letters}::double, -plain) AS score"
        f" FROM counts, share WHERE stops > 0) WHERE score >= {LEAST_SCORE!r}"
    )


def statements() -> dict[str, str]:
    docs = "SELECT doc_id, text AS full_text, source AS screen_name FROM documents"
    talks = (
        "SELECT conv_id * 1000 + turn AS doc_id, text AS full_text, role AS screen_name"
        " FROM conversations"
    )
    asked = "SELECT item_id AS query_id, text AS query FROM benchmark"
    top = (
        f"SELECT z, rank, word, p FROM (SELECT *, (row_number() OVER (PARTITION BY z ORDER BY p DESC,"
        f" word))::INT AS rank FROM ({_unpivot(LAST_W, 'word', 9)})) WHERE rank <= 10"
    )
    emoji = "regexp_replace(full_text, {}, '', 'g')"
    em_ctes, em_rows = _em_residuals(list(range(1, N_EM + 1)))
    last_ctes, last_rows = _em_residuals([N_EM])

    sql = {
        "corpus_projection": docs,
        "account_filter": f"{docs} WHERE source IN ({', '.join(map(_quote, ACCOUNTS))})",
        "account_table_filter": f"{docs} WHERE source IN (SELECT source FROM documents JOIN labels"
        " USING (doc_id) WHERE toxic = 1)",
        "latest_per_account": _with(CORPUS, tail=_newest(None)),
        "corpus_union": f"{docs} UNION ALL {talks}",
        "status_dedup": f"SELECT DISTINCT * FROM ({docs} UNION ALL {docs})",
        "generated_corpus": _with(
            CORPUS,
            tail=f"SELECT *, {_clean('full_text')} AS edited_text FROM ({_newest(ACCOUNTS)})",
        ),
        "corpus_files": "SELECT row_number() OVER (ORDER BY lang IS DISTINCT FROM 'en', doc_id) - 1 AS doc_id,"
        " doc_id AS source_id, coalesce(text, '') AS full_text, source AS screen_name FROM documents",
        "newest_stream": _with(
            CORPUS, tail=f"SELECT *, {_clean('full_text')} AS edited_text FROM ({_newest(None)})"
        ),
        "growing_counts": _with(
            CELLS,
            tail="SELECT row_number() OVER (ORDER BY word) - 1 AS word_id, word, sum(n) AS n,"
            " count(*) AS docs FROM cells GROUP BY word",
        ),
        "stream_ingest": f"SELECT *, {_clean('full_text')} AS edited_text FROM ({docs})",
        "clean_text": f"SELECT doc_id, {_clean('full_text')} AS edited_text FROM ({docs})",
        "clean_conversations": f"SELECT doc_id, {_clean('full_text')} AS edited_text FROM ({talks})",
        "abbreviations": _abbreviations(),
        "emoticon_filter": f"SELECT doc_id, {_kept(_tokens('full_text'), EMOTICON)} AS kept FROM ({docs})",
        "stopword_filter": f"SELECT doc_id, {_kept(_tokens('full_text'), STOP)} AS kept FROM ({docs})",
        "punctuation_filter": f"SELECT doc_id, {_kept(_tokens('full_text'), f'{PUNCT} OR {LINK}')} AS kept"
        f" FROM ({docs})",
        "normalize_colon": f"SELECT doc_id, replace(full_text, ':', '') AS text FROM ({docs})",
        "normalize_mojibake": f"SELECT doc_id, replace(full_text, {_quote(tx.MOJIBAKE_ELLIPSIS)}, '')"
        f" AS text FROM ({docs})",
        "normalize_ascii": f"SELECT doc_id, regexp_replace(full_text, {_quote(tx.NON_ASCII_RUN)}, ' ',"
        f" 'g') AS text FROM ({docs})",
        "strip_emoji": f"SELECT doc_id, {emoji.format(_quote(tx.EMOJI_RUN))} AS text FROM ({docs})",
        "term_counts": _with(CELLS, tail="SELECT * FROM cells"),
        "joint_distribution": _with(
            CELLS, tail="SELECT word, doc_id, round(n / total, 12) AS x FROM cells, size"
        ),
        "vocabulary": _with(
            CELLS, tail="SELECT row_number() OVER (ORDER BY word) - 1 AS word_id, word FROM vocab"
        ),
        "query_membership": _with(
            CELLS,
            _cte("terms", f"SELECT DISTINCT unnest({_query_words('query')}) AS word FROM ({asked})"),
            tail="SELECT word, CASE WHEN word IN (SELECT word FROM terms) THEN 1.0::double"
            " ELSE 1e-12::double END AS n FROM vocab",
        ),
        "seed_factors": _with(CELLS, _em_start(), tail=_stacked("w0", "d0")),
        "plsa_posterior": _with(
            CELLS,
            _em_start(),
            tail="SELECT word, doc_id, "
            + _cols(lambda z: f"round(x{z} / {_sum(lambda y: f'x{y}')}, 10) AS p{z}")
            + " FROM (SELECT word, doc_id, "
            + _cols(lambda z: f"z0.p{z} * w0.p{z} * d0.p{z} AS x{z}")
            + " FROM cells JOIN w0 USING (word) JOIN d0 USING (doc_id), z0)",
        ),
        "plsa_word_topics": _with(MODEL, tail=_unpivot(LAST_W, "word")),
        "plsa_doc_topics": _with(MODEL, tail=_unpivot(LAST_D, "doc_id")),
        "plsa_topic_prior": _with(
            MODEL,
            tail=" UNION ALL ".join(
                f"SELECT {z}::int AS z, round(p{z}, 10) AS p FROM {LAST_Z}" for z in Z
            ),
        ),
        "plsa_warm_start": _with(
            CELLS,
            _nmf_start(scaled=False, prefixes=("W", "H")),
            _to_plsa("fw0", "fh0", "n"),
            _cte("w0", f"SELECT word, {_cols(lambda z: f'greatest(p{z}, {EPS}) AS p{z}')} FROM nw"),
            _cte("d0", f"SELECT doc_id, {_cols(lambda z: f'greatest(p{z}, {EPS}) AS p{z}')} FROM nd"),
            _cte("z0", "SELECT * FROM nz"),
            *[_em_step(i) for i in range(N_EM)],
            tail=_stacked(LAST_W, LAST_D),
        ),
        "plsa_weighted": _with(
            CELLS,
            _cte("ones", "SELECT word, doc_id, 1.0::double AS n FROM cells"),
            _em(cells="ones"),
            tail=_stacked(LAST_W, LAST_D),
        ),
        "plsa_reconstruct": _with(
            MODEL,
            tail="SELECT word, doc_id, round("
            + _sum(lambda z: f"{LAST_Z}.p{z} * {LAST_W}.p{z} * {LAST_D}.p{z}")
            + f", 12) AS p FROM cells JOIN {LAST_W} USING (word) JOIN {LAST_D} USING (doc_id), {LAST_Z}",
        ),
        "plsa_history": _with(MODEL, *em_ctes, tail=" UNION ALL ".join(em_rows)),
        "model_residuals": _with(MODEL, *last_ctes, tail=last_rows[0]),
        "top_words": _with(MODEL, tail=top),
        "topic_summary": _with(
            MODEL,
            tail="SELECT z, 'Topic #' || z || ': ' || string_agg(word, ' ' ORDER BY rank) AS summary"
            f" FROM ({top}) GROUP BY z",
        ),
        "top_docs": _with(MODEL, tail=_ranked_docs(_long_docs(), "WHERE z = 0")),
        "topic_top_docs": _with(MODEL, tail=_ranked_docs(_long_docs())),
        "dominant_topic": _with(
            MODEL,
            tail="SELECT doc_id, z, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY"
            f" p DESC, z) AS rn FROM ({_long_docs()})) WHERE rn = 1",
        ),
        "best_doc_per_topic": _with(
            MODEL,
            tail="SELECT z, doc_id, p, screen_name, full_text FROM (SELECT *, row_number() OVER"
            f" (PARTITION BY z ORDER BY p DESC, doc_id) AS rn FROM ({_long_docs()}))"
            " JOIN corpus USING (doc_id) WHERE rn = 1",
        ),
        "nmf_to_plsa": _with(
            CELLS, _nmf_start(), _to_plsa("fw0", "fh0"), tail=_stacked("nw", "nd")
        ),
        "query_terms": f"SELECT query_id, unnest({_query_words('query')}) AS word FROM ({asked})",
        "fold_in": _long_shares(asked),
        "fold_in_smooth": _long_shares(asked, smooth=True),
        "search_smooth": _hits(asked, smooth=True),
        "search": _hits(f"SELECT 0::int AS query_id, {_quote(SEARCH_TEXT)} AS query"),
        "search_batch": _hits(asked),
        "search_oov": _hits(f"{asked} UNION ALL SELECT -1, {_quote(STRANGER)}", oov=True),
    }
    n = NMF_ITERATIONS
    for name, update, order in [
        ("nmf_kl", "kl", "WH"),
        ("nmf_divergence", "kl", "HW"),
        ("nmf_kl_frobenius", "mu", "WH"),
        ("nmf_frobenius", "mu", "HW"),
        ("nmf_hals", "hals", "HW"),
        ("nmf_anls", "anls", "HW"),
        ("nmf_anls_active", "anls", "HW"),
        ("nmf_anls_grouped", "anls", "HW"),
    ]:
        sql[name] = _with(
            CELLS, _nmf(update, order), _to_plsa(f"fw{n}", f"fh{n}"), tail=_stacked("nw", "nd")
        )
    sql["svd_spectrum"] = _with(CELLS, _lanczos(), tail=_spectrum(K))
    sql["nmf_pg"] = _with(
        CELLS, _nmf_searched(), _to_plsa(f"fw{n}", f"fh{n}"), tail=_stacked("nw", "nd")
    )
    sql["nmf_custom_start"] = _with(
        CELLS,
        _nmf("kl", "WH", _nmf_start(scaled=False, prefixes=("W", "H"))),
        _to_plsa(f"fw{n}", f"fh{n}"),
        tail=_stacked("nw", "nd"),
    )
    ctes, rows = _em_residuals(list(range(1, n + 1)))
    for tag, method in [("f", "sklearn"), ("g", "simple_MU")]:
        for i in range(1, n + 1):
            more, row = _residual_row(method, i, f"{tag}w{i}", f"{tag}h{i}", f"{tag}{i}")
            ctes.append(more)
            rows.append(row)
    kl, mu = _nmf("kl", "WH"), _nmf("mu", "HW", start="", tag="g")
    sql["nmf_compare"] = _with(
        CELLS, _em(n), kl, mu, *ctes, tail=" UNION ALL ".join(rows)
    )
    with _topics(MANY_TOPICS):
        sql["plsa_many_topics"] = _with(CELLS, _em(1), tail=_unpivot("w1", "word"))
    with _topics(EXAMPLE_TOPICS):
        sql["plsa_example_topics"] = _with(
            CELLS,
            _em(1),
            tail=" UNION ALL ".join(f"SELECT {z}::int AS z, round(p{z}, 9) AS p FROM z1" for z in Z),
        )
    with _topics(10):
        sql["plsa_defaults"] = _with(
            CELLS,
            _em(20),
            tail=" UNION ALL ".join(f"SELECT {z}::int AS z, round(p{z}, 9) AS p FROM z20" for z in Z),
        )
    return sql
