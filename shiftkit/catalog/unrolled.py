"""SQL of iterative jobs: each step a table, so that another engine can run the same steps."""

from __future__ import annotations

from ..fixtures import duck_u, duck_z
from ..operators.features import VARIANTS
from ..operators.shifts import FAMILIES, condition_name, removed_features
from ..operators.trees import POISSON, P, tree_hash


def kmeans_sql(source: str, d: int, k: int, rounds: int) -> str:
    """(k, fold) of population folds over ``src`` (k, x0, x1, ...): seeds one at a time, then ``rounds`` rounds."""
    xs = [f"x{i}" for i in range(d)]
    far = lambda c: "round(" + " + ".join(f"({x} - {c}_{x}) ** 2" for x in xs) + ", 9)"
    out = [source, "st as (select " + ", ".join(f"avg({x}) as m_{x}, coalesce(nullif(stddev_pop({x}), 0), 1) as s_{x}" for x in xs) + " from src)"]
    out.append("d0 as materialized (select k, " + ", ".join(f"round(({x} - m_{x}) / s_{x}, 9) as {x}" for x in xs) + ", 1e300::double as d from src, st)")
    out.append("c0 as materialized (select " + ", ".join(f"{x} as c0_{x}" for x in xs) + f" from d0 order by {duck_u('centre0')}, k limit 1)")
    for i in range(1, k):
        out.append(f"d{i} as materialized (select k, {', '.join(xs)}, least(d, {far(f'c{i - 1}')}) as d from d{i - 1}, c{i - 1})")
        out.append(f"c{i} as materialized (select " + ", ".join(f"{x} as c{i}_{x}" for x in xs) + f" from d{i} where d > 0 order by -ln(1 - {duck_u(f'centre{i}')}) / d, k limit 1)")
    out.append(f"w0 as materialized (select * from {', '.join(f'c{i}' for i in range(k))})")
    near = "list_position([" + ", ".join(far(f"c{i}") for i in range(k)) + "], least(" + ", ".join(far(f"c{i}") for i in range(k)) + "))"
    for r in range(rounds):
        out.append(f"a{r} as materialized (select {near} as f, {', '.join(xs)} from d0, w{r})")
        out.append(f"w{r + 1} as materialized (select " + ", ".join(f"coalesce((select round(avg({x}), 9) + 0.0 from a{r} where f = {i + 1}), c{i}_{x}) as c{i}_{x}" for i in range(k) for x in xs) + f" from w{r})")
    return "with " + ",\n".join(out) + f"\nselect k, {near}::int as fold from d0, w{rounds}"


def newton_sql(source: str, steps: int) -> str:
    """Logistic regression by unit over ``src`` (k, unit, role, a, b, y): counts and mean probabilities of its predictions."""
    out = [source, "src_m as materialized (select * from src)", "w0 as materialized (select unit, 0.0::double as c, 0.0::double as p, 0.0::double as q from src_m where role = 'train' group by 1)"]
    score = "1 / (1 + exp(-(c + p * a + q * b)))"
    for s in range(steps):
        out.append(
            f"m{s} as materialized (select unit, sum(pr - y) as g0, sum((pr - y) * a) + max(p) as g1, sum((pr - y) * b) + max(q) as g2, sum(h) + 1e-10 as h00, sum(h * a) as h01, sum(h * b) as h02, sum(h * a * a) + 1 as h11, sum(h * a * b) as h12, sum(h * b * b) + 1 as h22"
            f" from (select *, pr * (1 - pr) as h from (select *, {score} as pr from src_m join w{s} using (unit) where role = 'train')) group by 1)"
        )
        det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
        d0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
        d1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
        d2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
        out.append(f"w{s + 1} as materialized (select unit, c - {d0} / {det} as c, p - {d1} / {det} as p, q - {d2} / {det} as q from w{s} join m{s} using (unit))")
    return "with " + ",\n".join(out) + f"\nselect unit, role, y::varchar as y_true, (case when pr > 0.5 then 1 else 0 end)::varchar as y_pred, count(*) as n, round(avg(pr), 5) as p from (select *, {score} as pr from src_m join w{steps} using (unit)) group by all"


def lasso_sql(source: str, xs: list[str], y: str, alpha: float, sweeps: int) -> str:
    """(feature, l1) by coordinate sweeps over the moments of ``src``."""
    cov = [f"avg(({a} - m_{a}) * ({b} - m_{b})) as s_{a}_{b}" for i, a in enumerate([*xs, y]) for b in [*xs, y][i:]]
    name = lambda a, b: f"s_{a}_{b}" if [*xs, y].index(a) <= [*xs, y].index(b) else f"s_{b}_{a}"
    inner = f"select w.* exclude (i), i + 1 as i, s.* from w, s where i < {sweeps}"
    for j, a in enumerate(xs):
        r = f"({name(a, y)}" + "".join(f" - {name(a, b)} * {'n' if k < j else 'w'}_{b}" for k, b in enumerate(xs) if k != j) + ")"
        inner = f"select *, sign({r}) * greatest(abs({r}) - {alpha}, 0) / {name(a, a)} as n_{a} from ({inner})"
    step = f"select i, {', '.join(f'n_{a}' for a in xs)} from ({inner})"
    parts = [source, "m as (select " + ", ".join(f"avg({a}) as m_{a}" for a in [*xs, y]) + " from src)", f"s as materialized (select {', '.join(cov)} from src, m)"]
    rec = f"w(i, {', '.join(f'w_{a}' for a in xs)}) as (select 0, {', '.join('0.0::double' for _ in xs)} union all {step})"
    last = " union all ".join(f"select '{a}' as feature, round(abs(w_{a}), 4) + 0.0 as l1 from w where i = {sweeps}" for a in xs)
    return "with recursive " + ",\n".join([*parts, rec]) + "\n" + last


def forest_sql(source: str, features: list[str], trees: int, depth: int, take: int, bins: int = 32, seed: int = 42) -> str:
    """(unit, tree, node, label, n) of a forest's leaves over ``src`` (k, unit, y, features...), training rows only."""
    weights = "[" + ", ".join(repr(float(p)) for p in POISSON) + "]"
    hashes = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in ((t, tree_hash(seed, t)) for t in range(trees)))
    out = [source, "src_m as materialized (select * from src)"]
    for i, f in enumerate(features):
        out.append(
            f"e{i} as materialized (select list(e order by e)[:-2] as e from (select max(v) as e from (select v, sum(n) over (order by v) - n as before, sum(n) over () as total, count(*) over () as nv from (select {f} as v, count(*) as n from src_m group by 1))"
            f" group by case when nv <= {bins} then v else floor(before * {bins} / total) end))"
        )
    bins_of = ", ".join(f"len(list_filter(e{i}.e, lambda x: x < {f})) as b{i}" for i, f in enumerate(features))
    out.append(f"bn as materialized (select unit, y, cast(('0x' || substr(md5(concat_ws('|', '{seed}', 'bootstrap', k)), 1, 13)) as bigint) % {P} as h, {bins_of} from src_m, {', '.join(f'e{i}' for i in range(len(features)))})")
    bs = ", ".join(f"b{i}" for i in range(len(features)))
    out.append(f"n0 as materialized (select unit, t, y, {bs}, w, 0 as node from (select *, len(list_filter({weights}, lambda x: x <= ((h * a + b) % {P})::double / {P})) as w from bn, (values {hashes}) as tr(t, a, b)) where w > 0)")
    for level in range(depth):
        first = 2**level - 1
        long = " union all ".join(f"select unit, t, node, {i} as f, b{i} as bin, y, w from n{level} where node >= {first}" for i in range(len(features)))
        out.append(f"c{level} as materialized (select unit, t, node, f, bin, y, sum(w)::bigint as n from ({long}) group by all)")
        out.append(f"o{level} as materialized (select unit, t, node, y, sum(n)::bigint as n from c{level} where f = 0 group by all)")
        out.append(
            f"l{level} as materialized (select g.unit, g.t, g.node, g.f, g.bin, g.y, sum(coalesce(c.n, 0)) over (partition by g.unit, g.t, g.node, g.f, g.y order by g.bin)::bigint as l, g.n as total"
            f" from (select distinct c{level}.unit, c{level}.t, c{level}.node, f, bin, o{level}.y, o{level}.n from c{level} join o{level} using (unit, t, node)) g left join c{level} c on (c.unit, c.t, c.node, c.f, c.bin, c.y) = (g.unit, g.t, g.node, g.f, g.bin, g.y))"
        )
        out.append(
            f"s{level} as materialized (select unit, t, node, f, bin, sum(l * l)::double / sum(l) + sum((total - l) * (total - l))::double / sum(total - l) as score, sum(total * total)::double / sum(total) as parent from l{level} group by all having sum(l) > 0 and sum(total - l) > 0)"
        )
        allowed = f"(select unit, t, node, f from (select unit, t, node, unnest(range({len(features)})) as f from (select distinct unit, t, node from o{level})) qualify row_number() over (partition by unit, t, node order by md5(concat_ws('|', '{seed}', 'features', t, node, f))) <= {take})"
        out.append(f"p{level} as materialized (select unit, t, node, f, bin from s{level} join {allowed} using (unit, t, node, f) where score > parent * (1 + 1e-12) qualify row_number() over (partition by unit, t, node order by score desc, f, bin) = 1)")
        value = "case p.f " + " ".join(f"when {i} then b{i}" for i in range(len(features))) + " end"
        out.append(f"n{level + 1} as materialized (select n.unit, n.t, y, {bs}, w, case when p.f is null then n.node else 2 * n.node + 1 + ({value} > p.bin)::int end as node from n{level} n left join p{level} p on n.unit = p.unit and n.t = p.t and n.node = p.node)")
    return "with " + ",\n".join(out) + f"\nselect unit, t as tree, node, y::varchar as label, sum(w)::bigint as n from n{depth} group by all"


def experiment_sql(source: str, left_out: tuple[str, ...]) -> str:
    """(condition, pipeline, accuracy, n_retained, folds) of naive Bayes over ``src`` (k, a, b, target), whose classes have five rows or more."""
    conds = [(condition_name(f, s), f, s or 0.0) for f, ss in FAMILIES.items() if f not in left_out for s in ss]
    gone = removed_features(["a", "b"], 0.2, 42)
    other = "classes[((list_position(classes, target) - 1 + floor({u} * (len(classes) - 1))::int + 1) % len(classes)) + 1]".format(u=duck_u("to"))
    cell = lambda c: (
        f"case when train and family = 'missing_values' and {duck_u(f'lost|{c}')} < sev then null when train and family = 'gaussian_noise' then {c} + {duck_z(f'noise|{c}')} * sev * coalesce(nullif(sd_{c}, 0), 1)"
        + (" when family = 'feature_removal' then null" if c in gone else "") + f" else {c} end as {c}"
    )
    scaled = lambda c: f"coalesce((coalesce({c}, mean_{c}) - mean_{c}) / sdev_{c}, 0) as {c}"
    made = {"a": "a", "b": "b", "a + b": "a + b", "a - b": "a - b", "a * b": "a * b", "a / b": "coalesce(a / nullif(b, 0), 0)", "b / a": "coalesce(b / nullif(a, 0), 0)"}
    marks = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
    sets = [(p, f) for p, (derived, _, primitives) in VARIANTS.items() for f in made if f in ("a", "b") or (derived and f.split()[1] in {marks[x] for x in primitives})]
    text = lambda x: "'" + x + "'"
    return (
        f"with {source}, cond(condition, family, sev) as (values {', '.join(f'({text(c)}, {text(f)}, {s}::double)' for c, f, s in conds)}), cl as (select list(distinct target order by target) as classes from src),\n"
        f"fo as materialized (select *, (row_number() over (order by target, {duck_u('fold')}, k) - 1) % 5 + 1 as fold from src),\n"
        "un as materialized (select u.i::int as unit_fold, fo.*, fold <> u.i as train from fo, range(1, 6) u(i)),\n"
        "sd as (select unit_fold, stddev_pop(a) as sd_a, stddev_pop(b) as sd_b from un where train group by 1),\n"
        f"sh as materialized (select unit_fold, condition, k, train, {cell('a')}, {cell('b')}, target as y, case when train and family = 'label_noise' and {duck_u('flip')} < sev then {other} else target end as target from un join sd using (unit_fold), cond, cl),\n"
        "pa as (select unit_fold, condition, " + ", ".join(f"avg({c}) as mean_{c}, coalesce(nullif(stddev_pop({c}) * sqrt(count({c}) / count(*)), 0), 1) as sdev_{c}" for c in "ab") + " from sh where train group by 1, 2),\n"
        f"pr as materialized (select unit_fold, condition, k, train, y, target, {scaled('a')}, {scaled('b')} from sh join pa using (unit_fold, condition)),\n"
        f"lo as materialized (select unit_fold, condition, k, train, y, target, unnest([{', '.join(map(text, made))}]) as f, unnest([{', '.join(made.values())}]) as v from pr),\n"
        f"st as materialized (select unit_fold, condition, f, target as c, avg(v) as m, var_pop(v) as s from lo where train group by all),\n"
        "va as (select unit_fold, condition, f, var_pop(v) as s from lo where train group by all),\n"
        "nc as (select unit_fold, condition, target as c, count(*) as nc, sum(count(*)) over (partition by unit_fold, condition) as n from pr where train group by unit_fold, condition, target),\n"
        f"se(pipeline, f) as (values {', '.join(f'({text(p)}, {text(f)})' for p, f in sets)}),\n"
        "ep as (select unit_fold, condition, pipeline, 1e-9 * max(s) as eps from va join se using (f) group by all),\n"
        "ll as (select unit_fold, condition, pipeline, k, y, c, ln(max(nc) / max(n)) - sum(ln(2 * pi() * (s + eps)) / 2 + (v - m) ** 2 / (2 * (s + eps))) as l from lo join se using (f) join ep using (unit_fold, condition, pipeline) join st using (unit_fold, condition, f) join nc using (unit_fold, condition, c) where not train group by all),\n"
        "pd as (select unit_fold, condition, pipeline, k, y, arg_max(c, l) as p from ll group by all),\n"
        "ac as (select unit_fold, condition, pipeline, avg((y = p)::int) as accuracy from pd group by all)\n"
        "select condition, pipeline, round(avg(accuracy), 6) as accuracy, max(kept) as n_retained, count(*) as folds from ac join (select pipeline, count(*)::int as kept from se group by 1) using (pipeline) group by condition, pipeline"
    )
