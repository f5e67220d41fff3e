"""String, URL, JSON and hash functions."""

from tessera.functions.spec import scalar

scalar("customer", [
    ("ascii", "ascii(c_name)", None), ("chr", "chr(65 + c_nationkey)", "chr(65 + c_nationkey)"),
    ("elt", "elt(c_nationkey % 2 + 1, c_name, c_mktsegment)", "CASE c_nationkey % 2 WHEN 0 THEN c_name ELSE c_mktsegment END"),
    ("endswith", "endswith(c_name, '1')", "ends_with(c_name, '1')"), ("startswith", "startswith(c_mktsegment, 'B')", "starts_with(c_mktsegment, 'B')"),
    ("concat", "concat(c_name, '/', c_mktsegment)", None), ("contains", "contains(c_mktsegment, 'U')", None),
    ("strpos", "instr(c_mktsegment, 'I')", "instr(c_mktsegment, 'I')::INTEGER"), ("char_length", "char_length(c_name)", "length(c_name)::INTEGER"),
    ("lower", "lower(c_mktsegment)", None), ("upper", "upper(c_name)", None), ("soundex", "soundex(c_mktsegment)", ...),
    ("locate", "locate('I', c_mktsegment, 3)", "CASE WHEN instr(substr(c_mktsegment, 3), 'I') > 0 THEN (instr(substr(c_mktsegment, 3), 'I') + 2)::INTEGER ELSE 0 END"),
    ("ltrim", "ltrim('BA', c_mktsegment)", "ltrim(c_mktsegment, 'BA')"), ("rtrim", "rtrim('GY', c_mktsegment)", "rtrim(c_mktsegment, 'GY')"),
    ("trim", "trim(concat('  ', c_name, ' '))", None), ("btrim", "btrim(c_mktsegment, 'BG')", "trim(c_mktsegment, 'BG')"),
    ("lpad", "lpad(c_mktsegment, 12, '*-')", None), ("rpad", "rpad(c_mktsegment, 12, '*-')", None), ("replace", "replace(c_name, '0', 'o')", None),
    ("reverse", "reverse(c_name)", None), ("split", "array_join(split(c_name, '#'), '|')", "array_to_string(string_split(c_name, '#'), '|')"),
    ("substring", "substring(c_name, 3, 5)", None), ("substring_index", "substring_index(c_name, '#', 1)", "string_split(c_name, '#')[1]"),
    ("concat_ws", "concat_ws('-', c_name, NULL, c_mktsegment)", None), ("left", "left(c_name, 4)", None), ("right", "right(c_name, 4)", None),
    ("repeat", "repeat(c_mktsegment, 3)", None), ("translate", "translate(c_name, '0123', 'abcd')", None), ("space", "concat(space(3), c_name)", "repeat(' ', 3) || c_name"),
    ("initcap", "initcap(c_mktsegment)", "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"),
    ("overlay", "overlay(c_name PLACING 'XX' FROM 3 FOR 2)", "substr(c_name, 1, 2) || 'XX' || substr(c_name, 5)"),
    ("conv", "conv(cast(c_custkey as string), 10, 16)", "upper(to_base(c_custkey, 16))"), ("find_in_set", "find_in_set(c_mktsegment, 'BUILDING,MACHINERY,AUTOMOBILE')", "coalesce(list_position(['BUILDING', 'MACHINERY', 'AUTOMOBILE'], c_mktsegment), 0)::INTEGER"),
    ("decode", "decode(encode(c_name, 'utf-8'), 'utf-8')", "c_name"), ("encode", "hex(encode(c_name, 'utf-8'))", "hex(encode(c_name))"),
    ("uuid", "(uuid() rlike '^[0-9a-f]+-[0-9a-f]+-4[0-9a-f]+-[0-9a-f]+-[0-9a-f]+$') AND length(uuid()) = 36", "TRUE"), ("bit_length", "bit_length(c_name)", "bit_length(c_name)::INTEGER"), ("octet_length", "octet_length(c_name)", "strlen(c_name)::INTEGER"),
    ("levenshtein", "levenshtein(c_mktsegment, 'BUILDING')", "levenshtein(c_mktsegment, 'BUILDING')::INTEGER"),
    ("base64", "base64(encode(c_name, 'utf-8'))", "to_base64(encode(c_name))"), ("unbase64", "decode(unbase64(base64(encode(c_name, 'utf-8'))), 'utf-8')", "c_name"),
    ("format_string", "format_string('%s:%05d', c_mktsegment, c_custkey)", "printf('%s:%05d', c_mktsegment, c_custkey)"),
    ("like", "c_name LIKE '%1_'", None), ("not_like", "c_name NOT LIKE '%1%'", None), ("ilike", "c_mktsegment ILIKE '%build%'", None), ("rlike", "c_name RLIKE '[12]$'", "regexp_matches(c_name, '[12]$')"),
    ("regexp_replace", "regexp_replace(c_name, '[0-9]+', 'N')", "regexp_replace(c_name, '[0-9]+', 'N', 'g')"), ("regexp_extract", "regexp_extract(c_name, '([1-9][0-9]*)', 1)", None),
    ("regexp_extract_all", "array_join(regexp_extract_all(c_name, '([0-9])', 1), ',')", "array_to_string(regexp_extract_all(c_name, '([0-9])', 1), ',')"),
    ("split_part", "split_part(c_name, '#', 2)", None), ("mask", "mask(c_name)", "regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"),
    ("luhn_check", "luhn_check(cast(c_custkey as string))", "list_sum([CASE WHEN (length(c_custkey::VARCHAR) - i) % 2 = 0 THEN substr(c_custkey::VARCHAR, i, 1)::INT ELSE 2 * substr(c_custkey::VARCHAR, i, 1)::INT // 10 + 2 * substr(c_custkey::VARCHAR, i, 1)::INT % 10 END FOR i IN range(1, length(c_custkey::VARCHAR) + 1)]) % 10 = 0"), ("randstr", "length(randstr(5, 7))", "5"), ("parse_url", "parse_url(concat('https://h.example/p?k=', c_custkey, '#f'), 'QUERY', 'k')", "c_custkey::VARCHAR"),
    ("parse_url_host", "parse_url(concat('https://h', c_nationkey, '.example/p'), 'HOST')", "'h' || c_nationkey || '.example'"),
    ("url_encode", "url_encode(concat(c_name, ' &'))", "replace(replace(replace(c_name || ' &', '#', '%23'), '&', '%26'), ' ', '+')"), ("url_decode", "url_decode(url_encode(c_name))", "c_name"),
    ("md5", "md5(c_name)", None), ("sha1", "sha1(c_name)", None), ("sha2", "sha2(c_name, 256)", "sha256(c_name)"), ("crc32", "crc32(c_name)", ...), ("murmur3hash", "hash(c_name, c_custkey)", ...), ("xxhash64", "xxhash64(c_name, c_custkey)", ...),
    ("compare_substrings", "substring(c_name, 1, 3) < substring(c_mktsegment, 2, 3)", "substr(c_name, 1, 3) < substr(c_mktsegment, 2, 3)"), ("to_pretty_string", "coalesce(cast(nullif(c_nationkey, 3) as string), 'NULL')", "coalesce(nullif(c_nationkey, 3)::VARCHAR, 'NULL')"),
    ("empty2null", "nullif(if(c_nationkey > 10, '', c_mktsegment), '')", "CASE WHEN c_nationkey <= 10 THEN c_mktsegment END"), ("varchar_write_check", "cast(c_mktsegment as varchar(20))", "c_mktsegment"), ("char_padding", "rpad(c_mktsegment, 12, ' ')", None),
    ("char_write_check", "length(cast(c_mktsegment as char(12)))", "length(c_mktsegment)::INTEGER"),
])

scalar("events", [
    ("get_json_object", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("json_array_length", "json_array_length(concat('[', user_id, ',', event_id, ']'))", "2"),
    ("from_json", "from_json(props, 'k INT').k", "json_extract(props, '$.k')::INTEGER"), ("to_json", "to_json(named_struct('u', user_id, 't', event_type))", "'{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}'"),
    ("json_object_keys", "array_join(json_object_keys(props), ',')", "array_to_string(json_keys(props), ',')"), ("json_flatten_required", "get_json_object(to_json(named_struct('a', from_json(props, 'k INT'))), '$.a.k')", "json_extract_string(props, '$.k')"),
    ("json_nested", "get_json_object(to_json(named_struct('a', array(user_id, 7L))), '$.a[1]')", "'7'"),
])
