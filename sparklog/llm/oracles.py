"""SQL for DuckDB of the vector operators: the rounds written out one after another, by brute force."""


def _finite(vector: str) -> str:
    return f"{vector} is not null and len(list_filter({vector}, lambda x: x is null or not isfinite(x))) = 0"


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """All entries compared in every round."""
    steps = [f"""
kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
                      from embeddings where {_finite("embedding")}),
cut as materialized (select vec_id, label, p.p, v[p.p * (len(v) // {parts}) + 1 : (p.p + 1) * (len(v) // {parts})] as x
                     from kept, (select unnest(range({parts})) as p) p),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries}),
b0 as materialized (select p, e, x as c from cut join first using (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select vec_id, any_value(label) as label, p, any_value(x) as x, min(d) as d, arg_min(e, d * {entries} + e) as e
  from (select cut.*, b{i}.e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from cut join b{i} using (p))
  group by vec_id, p)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from (
           select p, e, i, sum(y)::bigint as s, count(*) as n
           from (select p, e, unnest(x) as y, generate_subscripts(x, 1) as i from a{i}) group by p, e, i)
         group by p, e),
b{i + 1} as materialized (select b{i}.p, b{i}.e, coalesce(m{i}.c, b{i}.c) as c from b{i} left join m{i} using (p, e))""")
    last = rounds
    return "with" + ",".join(steps) + f""",
each as (select vec_id, any_value(label) as label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' order by p) as code, sum(d)::bigint as error
         from a{last} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b{last}) as codebooks_sha256
from each"""


def clusters(k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: int = 1) -> str:
    steps = [f"""
kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
                      from embeddings where len(embedding) = {length} and {_finite("embedding")}),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v as c from kept qualify cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select vec_id, any_value(v) as v, min(d) as d, arg_min(cluster, d * {k} + cluster) as cluster
  from (select vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i})
  group by vec_id)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from (
           select cluster, i, sum(y)::bigint as s, count(*) as n
           from (select cluster, unnest(v) as y, generate_subscripts(v, 1) as i from a{i}) group by cluster, i) group by cluster),
c{i + 1} as materialized (select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))""")
    last = rounds
    return "with" + ",".join(steps) + f"""
select vec_id, a{last}.cluster::int as cluster, d as distance, sum(d) over (partition by a{last}.cluster)::bigint as cluster_inertia,
       sum(d) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{last} join c{last} using (cluster)"""
