"""Operators, predicates, casts, mathematics, bits, conditionals and decimals."""

from tessera.functions.spec import scalar

scalar("customer", [
    ("add", "c_acctbal + c_custkey", None), ("subtract", "c_acctbal - c_nationkey", None), ("multiply", "c_acctbal * 2", None), ("divide", "round(c_acctbal / (c_nationkey + 1), 6)", None),
    ("div", "c_custkey div (c_nationkey + 1)", "(c_custkey // (c_nationkey + 1))::BIGINT"), ("modulus", "c_custkey % 7", None), ("pmod", "pmod(-c_custkey, 7)", "((-c_custkey % 7) + 7) % 7"),
    ("positive", "+c_acctbal", None), ("negative", "-c_acctbal", None), ("and", "c_acctbal > 0 AND c_nationkey > 5", None), ("or", "c_acctbal > 0 OR c_nationkey > 5", None), ("not", "NOT c_acctbal > 0", None),
    ("xor", "(c_acctbal > 0) <> (c_nationkey > 5)", None),
    ("cast_string", "cast(c_custkey as string)", "c_custkey::VARCHAR"), ("cast_int", "cast(c_acctbal as int)", "trunc(c_acctbal)::INTEGER"), ("cast_decimal", "cast(cast(c_acctbal as decimal(12,2)) as double)", "round(c_acctbal, 2)"), ("cast_boolean", "cast(c_nationkey as boolean)", "c_nationkey <> 0"),
    ("cast_array_string", "cast(array(c_custkey, c_nationkey) as string)", "'[' || c_custkey || ', ' || c_nationkey || ']'"), ("try_cast", "try_cast(c_mktsegment as int)", "try_cast(c_mktsegment as int)"),
    ("coalesce", "coalesce(nullif(c_nationkey, 3), -1)", None), ("equal", "c_nationkey = 3", None), ("equal_null_safe", "nullif(c_nationkey, 3) <=> NULL", "nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL"), ("equal_null", "equal_null(nullif(c_nationkey, 3), NULL)", "nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL"),
    ("lt", "c_acctbal < 100", None), ("lte", "c_acctbal <= 100", None), ("gt", "c_acctbal > 100", None), ("gte", "c_acctbal >= 100", None), ("between", "c_acctbal BETWEEN 0 AND 5000", None),
    ("is_null", "nullif(c_nationkey, 3) IS NULL", None), ("is_not_null", "nullif(c_nationkey, 3) IS NOT NULL", None), ("isnan", "isnan(c_acctbal)", None), ("nanvl", "nanvl(if(c_nationkey = 3, double('NaN'), c_acctbal), 0D)", "CASE WHEN c_nationkey = 3 THEN 0::DOUBLE ELSE c_acctbal END"),
    ("try_add", "try_add(c_custkey, 1)", "c_custkey + 1"), ("try_divide", "round(try_divide(c_acctbal, c_nationkey), 6)", "round(c_acctbal / nullif(c_nationkey, 0), 6)"),
    ("checked_add", "try_add(9223372036854775800L, c_custkey)", "try_cast(9223372036854775800::HUGEINT + c_custkey AS BIGINT)"), ("checked_subtract", "try_subtract(-9223372036854775800L, c_custkey)", "try_cast(-9223372036854775800::HUGEINT - c_custkey AS BIGINT)"),
    ("checked_multiply", "try_multiply(4611686018427387904L, c_nationkey)", "try_cast(4611686018427387904::HUGEINT * c_nationkey AS BIGINT)"), ("checked_divide", "try_divide(c_custkey, c_nationkey - 3)", "CASE WHEN c_nationkey <> 3 THEN c_custkey / (c_nationkey - 3) END"), ("checked_div", "if(c_nationkey = 3, NULL, c_custkey div (c_nationkey - 3))", "CASE WHEN c_nationkey <> 3 THEN c_custkey // (c_nationkey - 3) END"), ("try_mod", "try_mod(c_custkey, c_nationkey)", "CASE WHEN c_nationkey <> 0 THEN c_custkey % c_nationkey END"),
    ("abs", "abs(c_acctbal)", None), ("bin", "bin(c_custkey)", "bin(c_custkey)"), ("ceil", "ceil(c_acctbal)", "ceil(c_acctbal)::BIGINT"), ("floor", "floor(c_acctbal)", "floor(c_acctbal)::BIGINT"),
    ("round_floor", "cast(floor(cast(c_acctbal as decimal(12,2)), 1) as double)", "floor(round(c_acctbal, 2)::DECIMAL(12,2) * 10)::DOUBLE / 10"), ("round_ceil", "cast(ceil(cast(c_acctbal as decimal(12,2)), 1) as double)", "ceil(round(c_acctbal, 2)::DECIMAL(12,2) * 10)::DOUBLE / 10"),
    ("exp", "round(exp(c_nationkey / 10D), 6)", "round(exp(c_nationkey / 10), 6)"), ("expm1", "round(expm1(c_nationkey / 10D), 6)", "round(exp(c_nationkey / 10) - 1, 6)"), ("power", "round(power(c_nationkey, 1.5D), 5)", "round(power(c_nationkey, 1.5), 5)"),
    ("round", "round(c_acctbal, 1)", None), ("bround", "bround(cast(c_nationkey as double) / 2, 0)", "round_even(c_nationkey / 2, 0)"), ("rint", "rint(c_nationkey / 2D)", "round_even(c_nationkey / 2, 0)"),
    ("sin", "round(sin(c_nationkey), 9)", None), ("cos", "round(cos(c_nationkey), 9)", None), ("tan", "round(tan(c_nationkey), 6)", None), ("cot", "round(cot(c_nationkey + 1), 6)", None),
    ("sec", "round(sec(c_nationkey), 6)", "round(1 / cos(c_nationkey), 6)"), ("csc", "round(csc(c_nationkey + 1), 6)", "round(1 / sin(c_nationkey + 1), 6)"),
    ("sinh", "round(sinh(c_nationkey / 10D), 9)", "round(sinh(c_nationkey / 10), 9)"), ("cosh", "round(cosh(c_nationkey / 10D), 9)", "round(cosh(c_nationkey / 10), 9)"), ("tanh", "round(tanh(c_nationkey / 10D), 9)", "round(tanh(c_nationkey / 10), 9)"),
    ("asin", "round(asin(c_nationkey / 30D), 9)", "round(asin(c_nationkey / 30), 9)"), ("acos", "round(acos(c_nationkey / 30D), 9)", "round(acos(c_nationkey / 30), 9)"), ("atan", "round(atan(c_nationkey), 9)", None), ("atan2", "round(atan2(c_nationkey, 3), 9)", None),
    ("asinh", "round(asinh(c_nationkey), 9)", None), ("acosh", "round(acosh(c_nationkey + 1), 9)", None), ("atanh", "round(atanh(c_nationkey / 30D), 9)", "round(atanh(c_nationkey / 30), 9)"),
    ("degrees", "round(degrees(c_nationkey), 8)", None), ("radians", "round(radians(c_nationkey), 9)", None), ("hypot", "round(hypot(c_nationkey, 4), 8)", "round(sqrt(c_nationkey * c_nationkey + 16), 8)"),
    ("sqrt", "round(sqrt(c_nationkey), 9)", None), ("cbrt", "round(cbrt(c_nationkey), 9)", None), ("e", "round(e() * c_nationkey, 8)", "round(exp(1) * c_nationkey, 8)"), ("pi", "round(pi() * c_nationkey, 8)", None),
    ("hex", "hex(c_custkey)", "hex(c_custkey)"), ("unhex", "decode(unhex(hex(c_name)), 'utf-8')", "c_name"), ("sign", "sign(c_acctbal)", "sign(c_acctbal)::DOUBLE"),
    ("log10", "round(log10(c_custkey + 1), 9)", None), ("log1p", "round(log1p(c_custkey), 9)", "round(ln(1 + c_custkey), 9)"), ("log2", "round(log2(c_custkey + 1), 9)", None), ("ln", "round(ln(c_custkey + 1), 9)", None), ("log", "round(log(3, c_custkey + 1), 9)", "round(ln(c_custkey + 1) / ln(3), 9)"),
    ("greatest", "greatest(c_custkey, c_nationkey, 40)", "greatest(c_custkey, c_nationkey, 40)"), ("least", "least(c_custkey, c_nationkey, 40)", "least(c_custkey, c_nationkey, 40)"), ("factorial", "factorial(c_nationkey % 15)", "factorial(c_nationkey % 15)::BIGINT"),
    ("rand", "rand(7) BETWEEN 0 AND 1", "TRUE"), ("width_bucket", "width_bucket(c_acctbal, -1000, 10000, 11)", "CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE floor((c_acctbal + 1000) / 1000)::BIGINT + 1 END"),
    ("bitwise_not", "~c_nationkey", None), ("bitwise_and", "c_custkey & 12", None), ("bitwise_or", "c_custkey | 12", None), ("bitwise_xor", "c_custkey ^ 12", "xor(c_custkey, 12)"), ("bit_get", "bit_get(c_custkey, 2)", "((c_custkey >> 2) & 1)::TINYINT"), ("bit_count", "bit_count(c_custkey)", "bit_count(c_custkey)::INTEGER"),
    ("shiftleft", "shiftleft(c_nationkey, 3)", "c_nationkey << 3"), ("shiftright", "shiftright(c_custkey, 2)", "c_custkey >> 2"), ("shiftrightunsigned", "shiftrightunsigned(c_custkey, 2)", "c_custkey >> 2"),
    ("if", "if(c_acctbal > 0, 'plus', 'minus')", None), ("case_when", "CASE WHEN c_nationkey < 5 THEN 'a' WHEN c_nationkey < 10 THEN 'b' ELSE 'c' END", None), ("in", "c_nationkey IN (1, 3, 5)", None),
    ("in_set", "c_nationkey IN (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23)", None), ("nullif", "nullif(c_nationkey, 3)", None), ("nvl", "nvl(nullif(c_nationkey, 3), 0)", "coalesce(nullif(c_nationkey, 3), 0)"), ("nvl2", "nvl2(nullif(c_nationkey, 3), 1, 0)", "CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 0 ELSE 1 END"),
    ("assert_true", "assert_true(c_custkey IS NOT NULL) IS NULL", "TRUE"), ("raise_error", "if(c_custkey IS NULL, raise_error('no key'), c_custkey)", "c_custkey"), ("version", "length(version()) > 0", "TRUE"), ("literal", "1", "1"), ("alias", "c_custkey", None),
    ("spark_partition_id", "spark_partition_id() >= 0", "TRUE"), ("monotonically_increasing_id", "monotonically_increasing_id() >= 0", "TRUE"), ("at_least_n_non_nulls", "int(nullif(c_nationkey, 3) IS NOT NULL) + int(c_name IS NOT NULL) >= 2", "c_nationkey <> 3"),
    ("check_overflow", "cast(cast(c_acctbal as decimal(12,2)) * cast(2 as decimal(12,2)) as double)", "round(c_acctbal, 2) * 2"), ("make_decimal", "cast(cast(c_custkey as decimal(10,2)) as string)", "c_custkey || '.00'"), ("unscaled_value", "cast(cast(c_acctbal as decimal(12,2)) * 100 as bigint)", "round(c_acctbal * 100)::BIGINT"),
    ("promote_precision", "cast(cast(c_nationkey as decimal(5,1)) + cast(1.25 as decimal(7,3)) as double)", "c_nationkey + 1.25::DOUBLE"), ("known_not_null", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')", None),
    ("decimal_add", "cast(cast(c_acctbal as decimal(12,2)) + cast(c_custkey as decimal(10,3)) as double)", "round(c_acctbal, 2) + c_custkey"), ("decimal_subtract", "cast(cast(c_acctbal as decimal(12,2)) - cast(c_custkey as decimal(10,3)) as double)", "round(c_acctbal, 2) - c_custkey"),
    ("decimal_divide", "round(cast(cast(c_acctbal as decimal(12,2)) / cast(4 as decimal(4,1)) as double), 4)", "round(round(c_acctbal, 2) / 4, 4)"), ("decimal_modulo", "cast(cast(c_custkey as decimal(12,2)) % cast(7 as decimal(4,1)) as double)", "(c_custkey % 7)::DOUBLE"), ("decimal_round", "cast(round(cast(c_acctbal as decimal(12,2)), 0) as double)", "round(round(c_acctbal, 2), 0)"),
    ("cast_float_string", "cast(cast(c_nationkey as double) as string)", "c_nationkey || '.0'"), ("cast_timestamp_long", "cast(timestamp_seconds(c_custkey) as bigint)", "c_custkey"), ("cast_map_string", "cast(map('k', c_nationkey) as string)", "'{k -> ' || c_nationkey || '}'"), ("cast_struct_string", "cast(struct(c_nationkey, c_custkey) as string)", "'{' || c_nationkey || ', ' || c_custkey || '}'"),
    ("typeof", "typeof(c_custkey)", "'bigint'"), ("scalar_subquery", "c_acctbal > (SELECT avg(c_acctbal) FROM {customer})", "c_acctbal > (SELECT avg(c_acctbal) FROM customer)"),
    ("named_struct", "named_struct('a', c_custkey, 'b', c_name).b", "c_name"), ("get_struct_field", "struct(c_custkey AS k, c_nationkey AS n).n", "c_nationkey"),
])
