"""Array, map, struct, higher-order and generator functions.

Arrays are compared joined to text, because engines differ in how they print nested values.
"""

from tessera.functions.spec import scalar, whole

A, B = "array(c_nationkey, c_nationkey + 2, c_nationkey, 9)", "array(9, 4, c_nationkey)"
a, b = "[c_nationkey, c_nationkey + 2, c_nationkey, 9]", "[9, 4, c_nationkey]"
M = "map('a', c_nationkey, 'b', 7)"


def j(x: str) -> str:
    return f"array_join({x}, ',')"


def k(x: str) -> str:
    return f"array_to_string({x}, ',')"


def lam(body: str, arg: str = "x") -> str:
    return f"lambda {arg}: {body}"


scalar("customer", [
    ("array", j(A), k(a)), ("size", f"size({A})", "4"), ("array_size", f"array_size({A})", "4"), ("slice", j(f"slice({A}, 2, 2)"), k(f"({a})[2:3]")), ("sequence", j("sequence(1, c_nationkey + 1)"), k("range(1, c_nationkey + 2)")),
    ("sequence_date", j("transform(sequence(date'2020-01-01', date'2020-01-03', interval 1 day), x -> cast(x as string))"), "'2020-01-01,2020-01-02,2020-01-03'"),
    ("transform", j(f"transform({A}, x -> x * 2)"), k(f"list_transform({a}, {lam('x * 2')})")), ("filter", j(f"filter({A}, x -> x > 5)"), k(f"list_filter({a}, {lam('x > 5')})")), ("aggregate", f"aggregate({A}, 0, (s, x) -> s + x)", f"list_sum({a})::INTEGER"),
    ("exists", f"exists({A}, x -> x = 5)", f"list_contains({a}, 5)"), ("forall", f"forall({A}, x -> x < 20)", f"len(list_filter({a}, {lam('x >= 20')})) = 0"), ("zip_with", j(f"zip_with({B}, {B}, (x, y) -> x + y)"), k(f"list_transform({b}, {lam('x * 2')})")),
    ("get_array_item", f"{A}[1]", f"({a})[2]"), ("get", f"get({A}, 9)", "NULL::INTEGER"), ("element_at", f"element_at({A}, -1)", "9"), ("array_contains", f"array_contains({A}, 5)", f"list_contains({a}, 5)"), ("array_max", f"array_max({A})", f"list_max({a})"), ("array_min", f"array_min({A})", f"list_min({a})"),
    ("array_join", f"array_join({A}, '-', '?')", f"array_to_string({a}, '-')"), ("sort_array", j(f"sort_array({A}, false)"), k(f"list_reverse_sort({a})")), ("array_sort", j(f"array_sort({A}, (x, y) -> y - x)"), k(f"list_reverse_sort({a})")), ("arrays_overlap", f"arrays_overlap({A}, array(4, 5))", f"list_has_any({a}, [4, 5])"),
    ("array_position", f"array_position({A}, 9)", f"list_position({a}, 9)::BIGINT"), ("array_distinct", j(f"sort_array(array_distinct({A}))"), k(f"list_sort(list_distinct({a}))")), ("array_union", j(f"sort_array(array_union({A}, {B}))"), k(f"list_sort(list_distinct(list_concat({a}, {b})))")),
    ("array_intersect", j(f"sort_array(array_intersect({A}, {B}))"), k(f"list_sort(list_distinct(list_intersect({a}, {b})))")), ("array_except", j(f"sort_array(array_except({A}, {B}))"), k(f"list_sort(list_distinct(list_filter({a}, {lam(f'NOT list_contains({b}, x)')})))")), ("array_repeat", j("array_repeat(c_nationkey, 3)"), k("[c_nationkey, c_nationkey, c_nationkey]")),
    ("array_remove", j(f"array_remove({A}, 9)"), k(f"list_filter({a}, {lam('x <> 9')})")), ("arrays_zip", "arrays_zip(array(1, 2), array(c_nationkey, 4))[0]['1']", "c_nationkey"), ("array_insert", j(f"array_insert({A}, 2, 77)"), k("[c_nationkey, 77, c_nationkey + 2, c_nationkey, 9]")), ("array_append", j(f"array_append({A}, 77)"), k(f"list_append({a}, 77)")),
    ("array_prepend", j(f"array_prepend({A}, 77)"), k(f"list_prepend(77, {a})")), ("array_compact", j("array_compact(array(1, nullif(c_nationkey, 3), 2))"), k(f"list_filter([1, nullif(c_nationkey, 3), 2], {lam('x IS NOT NULL')})")), ("shuffle", j(f"sort_array(shuffle({A}))"), k(f"list_sort({a})")), ("flatten", j(f"flatten(array({A}, {B}))"), k(f"flatten([{a}, {b}])")),
    ("reverse_array", j(f"reverse({A})"), k(f"list_reverse({a})")), ("get_array_struct_fields", j("array(named_struct('p', c_nationkey), named_struct('p', 4)).p"), k("[c_nationkey, 4]")),
    ("map", f"{M}['a']", "c_nationkey"), ("get_map_value", f"element_at({M}, 'b')", "7"), ("map_concat", f"map_concat({M}, map('c', 8))['c']", "8"), ("map_keys", j(f"map_keys({M})"), "'a,b'"), ("map_values", j(f"map_values({M})"), k("[c_nationkey, 7]")), ("map_from_arrays", "map_from_arrays(array('x', 'y'), array(1, c_nationkey))['y']", "c_nationkey"),
    ("map_entries", f"map_entries({M})[0].value", "c_nationkey"), ("map_zip_with", f"map_zip_with({M}, {M}, (q, x, y) -> x + y)['a']", "c_nationkey * 2"), ("str_to_map", "str_to_map(concat('a=', c_nationkey, ';b=2'), ';', '=')['a']", "c_nationkey::VARCHAR"), ("transform_keys", f"map_keys(transform_keys({M}, (q, v) -> upper(q)))[0]", "'A'"),
    ("transform_values", f"transform_values({M}, (q, v) -> v + 1)['a']", "c_nationkey + 1"), ("map_filter", f"size(map_filter({M}, (q, v) -> v > 7))", "CASE WHEN c_nationkey > 7 THEN 1 ELSE 0 END"), ("map_contains_key", f"map_contains_key({M}, 'a')", "TRUE"), ("map_from_entries", f"map_from_entries(map_entries({M}))['a']", "c_nationkey"),
])

whole("gen", [
    ("explode", "SELECT n_nationkey, x FROM {nation} LATERAL VIEW explode(array(n_nationkey, n_regionkey)) AS x", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation"),
    ("explode_outer", "SELECT n_nationkey, x FROM {nation} LATERAL VIEW OUTER explode(if(n_regionkey = 0, array(), array(n_regionkey))) AS x", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN n_regionkey END AS x FROM nation"),
    ("posexplode", "SELECT n_nationkey, p, x FROM {nation} LATERAL VIEW posexplode(array(n_nationkey, n_regionkey)) AS p, x", "SELECT n_nationkey, p::INTEGER AS p, CASE p WHEN 0 THEN n_nationkey ELSE n_regionkey END AS x FROM nation, range(2) r(p)"),
    ("inline", "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW inline(array(named_struct('k', 1, 'v', n_name), named_struct('k', 2, 'v', 'z'))) AS k, v", "SELECT n_nationkey, p::INTEGER AS k, CASE p WHEN 1 THEN n_name ELSE 'z' END AS v FROM nation, range(1, 3) r(p)"),
    ("stack", "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW stack(2, 'a', n_nationkey, 'b', n_regionkey) AS k, v", "SELECT n_nationkey, 'a' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey FROM nation"),
    ("json_tuple", "SELECT event_id, k FROM {events} LATERAL VIEW json_tuple(props, 'k') AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    ("map_explode", "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW explode(map('a', n_nationkey, 'b', n_regionkey)) AS k, v", "SELECT n_nationkey, 'a' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey FROM nation"),
    ("replicate_rows", "SELECT n_nationkey, n_name FROM {nation} LATERAL VIEW explode(array_repeat(1, n_regionkey)) AS one", "SELECT n_nationkey, n_name FROM nation, range(5) r(i) WHERE i < n_regionkey"),
    ("range_source", "SELECT id * 3 AS v FROM range(0, 1000, 7, 4)", "SELECT range * 3 AS v FROM range(0, 1000, 7)"),
])
