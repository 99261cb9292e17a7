"""The dialect's scalar and aggregate functions as Spark SQL.

Each entry maps a call to an expression over its arguments: ``$1`` to ``$9``,
``$*`` for all, ``$n`` for their number. What Spark spells the same is not
listed. Everything here stays in Catalyst's own expressions; what those can't
say is in :mod:`millrace.functions.python` under names that begin with ``mr_``.
"""

from __future__ import annotations

from decimal import Decimal

_TEXT = r"""
-- conditions and errors
NULLIFZERO: nullif($1, 0)
ZEROIFNULL: coalesce($1, 0)
ERROR: raise_error($1)
IS_INF: (abs($1) = double('Infinity'))
IS_NAN: isnan($1)
-- arithmetic
ABS: abs($1)
SIGN: (case when ($1) > 0 then 1 when ($1) < 0 then -1 else ($1) * 0 end)
CEIL/1: (case when abs(double($1)) = double('Infinity') then ($1) when ($1) > -1 and ($1) < 0 then ($1) * 0 when ($1) % 1 > 0 then ($1) - ($1) % 1 + 1 else ($1) - ($1) % 1 end)
CEILING/1: (case when abs(double($1)) = double('Infinity') then ($1) when ($1) > -1 and ($1) < 0 then ($1) * 0 when ($1) % 1 > 0 then ($1) - ($1) % 1 + 1 else ($1) - ($1) % 1 end)
FLOOR/1: (case when abs(double($1)) = double('Infinity') then ($1) when ($1) % 1 < 0 then ($1) - ($1) % 1 - 1 else ($1) - ($1) % 1 end)
TRUNC/1: (case when abs(double($1)) = double('Infinity') then ($1) when ($1) > -1 and ($1) < 0 then ($1) * 0 else ($1) - ($1) % 1 end)
TRUNC/2: (case when abs(round(($1), $2)) > abs($1) then round(round(($1), $2) - (case when ($1) < 0 then -1 else 1 end) * $ulp2, $2) else round(($1), $2) end)
ROUND/3: (case when upper($3) = 'ROUND_HALF_EVEN' then bround($1, $2) else round($1, $2) end)
MOD: ($1 % $2)
DIV: ($1 div $2)
IEEE_DIVIDE: (case when $2 <> 0 or isnan($2) then cast($1 as double) / cast($2 as double) when $1 = 0 or isnan($1) then double('NaN') when $1 > 0 then double('Infinity') else double('-Infinity') end)
SAFE_DIVIDE: try_divide($1, $2)
SAFE_ADD: try_add($1, $2)
SAFE_SUBTRACT: try_subtract($1, $2)
SAFE_MULTIPLY: try_multiply($1, $2)
SAFE_NEGATE: try_subtract(0, $1)
SQRT: (case when $1 < 0 then cast(raise_error('SQRT of a negative number') as double) else sqrt($1) end)
LN: (case when $1 <= 0 then cast(raise_error('LN of a number that is not positive') as double) else ln($1) end)
LOG/1: (case when $1 <= 0 then cast(raise_error('LOG of a number that is not positive') as double) else ln($1) end)
LOG/2: (case when $1 <= 0 or $2 <= 0 or $2 = 1 then cast(raise_error('LOG out of its domain') as double) else log($2, $1) end)
LOG10: (case when $1 <= 0 then cast(raise_error('LOG10 of a number that is not positive') as double) else log10($1) end)
ACOSH: (case when $1 < 1 then cast(raise_error('ACOSH out of its domain') as double) else acosh($1) end)
ACOS: (case when abs($1) > 1 then cast(raise_error('ACOS out of its domain') as double) else acos($1) end)
ASIN: (case when abs($1) > 1 then cast(raise_error('ASIN out of its domain') as double) else asin($1) end)
ATANH: (case when abs($1) >= 1 then cast(raise_error('ATANH out of its domain') as double) else atanh($1) end)
COTH: (1 / tanh($1))
CSCH: (1 / sinh($1))
SECH: (1 / cosh($1))
LEAST: (case when $null then null else least($*) end)
GREATEST: (case when $null then null else greatest($*) end)
PI_NUMERIC: cast(3.141592654 as decimal(38,9))
PI_BIGNUMERIC: cast(3.141592653589793238 as decimal(38,18))
RANGE_BUCKET: (case when $1 is null or $2 is null then null else cast(size(filter($2, __e -> __e <= $1)) as bigint) end)
PARSE_NUMERIC: cast(regexp_replace(trim($1), '[ ,]', '') as decimal(38,9))
PARSE_BIGNUMERIC: cast(regexp_replace(trim($1), '[ ,]', '') as decimal(38,18))
RAND: rand()
-- bits
BIT_CAST_TO_UINT32: (cast($1 as bigint) & 4294967295)
BIT_CAST_TO_INT32: cast(case when (cast($1 as bigint) & 4294967295) > 2147483647 then (cast($1 as bigint) & 4294967295) - 4294967296 else cast($1 as bigint) & 4294967295 end as int)
BIT_CAST_TO_UINT64: (case when $1 < 0 then cast($1 as decimal(20,0)) + 18446744073709551616 else cast($1 as decimal(20,0)) end)
BIT_CAST_TO_INT64: cast(case when $1 > 9223372036854775807 then $1 - 18446744073709551616 else $1 end as bigint)
-- strings
BYTE_LENGTH: octet_length($1)
LENGTH: cast(length($1) as bigint)
CHARACTER_LENGTH: cast(char_length($1) as bigint)
CHAR_LENGTH: cast(char_length($1) as bigint)
STARTS_WITH: startswith($1, $2)
ENDS_WITH: endswith($1, $2)
STRPOS: cast(instr($1, $2) as bigint)
INSTR/2: cast(instr($1, $2) as bigint)
INSTR/3: cast(locate($2, $1, $3) as bigint)
INSTR/4: mr_instr($1, $2, cast($3 as bigint), cast($4 as bigint))
SUBSTR/2: substring($1, $2)
SUBSTR/3: (case when $3 < 0 then raise_error('SUBSTR with a negative length') else substring($1, case when $2 = 0 then 1 else $2 end, $3) end)
REPEAT: (case when $2 < 0 then raise_error('REPEAT with a negative count') else repeat($1, cast($2 as int)) end)
SPLIT/1: split($1, ',')
SPLIT/2: (case when $2 = '' then split($1, '') else split($1, concat('\\Q', $2, '\\E'), -1) end)
SPLIT_SUBSTR/3: array_join(slice(split($1, concat('\\Q', $2, '\\E'), -1), case when $3 = 0 then 1 else cast($3 as int) end, 2147483647), $2)
SPLIT_SUBSTR/4: array_join(slice(split($1, concat('\\Q', $2, '\\E'), -1), case when $3 = 0 then 1 else cast($3 as int) end, cast($4 as int)), $2)
TRIM/2: trim(both $2 from $1)
LTRIM/2: trim(leading $2 from $1)
RTRIM/2: trim(trailing $2 from $1)
LPAD/2: lpad($1, cast($2 as int), ' ')
RPAD/2: rpad($1, cast($2 as int), ' ')
UNICODE: (case when $1 = '' then 0L else cast(ascii($1) as bigint) end)
ASCII: cast(ascii($1) as bigint)
CHR: mr_chr(cast($1 as bigint))
TO_CODE_POINTS: mr_to_code_points($1)
CODE_POINTS_TO_STRING: mr_code_points_to_string(cast($1 as array<bigint>))
CODE_POINTS_TO_BYTES: mr_code_points_to_bytes(cast($1 as array<bigint>))
INITCAP/1: mr_initcap($1, ' <>[]{}()/|!?@"^#$&~_,.:;*%+-\\\\\t\n\r\f')
INITCAP/2: mr_initcap($1, $2)
NORMALIZE/1: mr_normalize($1, 'NFC')
NORMALIZE/2: mr_normalize($1, upper('$2'))
NORMALIZE_AND_CASEFOLD/1: mr_normalize_and_casefold($1, 'NFC')
NORMALIZE_AND_CASEFOLD/2: mr_normalize_and_casefold($1, upper('$2'))
FORMAT: mr_format($1, array($rest_strings))
TO_BASE64: base64($1)
FROM_BASE64: unbase64($1)
TO_BASE32: mr_to_base32($1)
FROM_BASE32: mr_from_base32($1)
TO_HEX: lower(hex($1))
FROM_HEX: unhex($1)
SAFE_CONVERT_BYTES_TO_STRING: make_valid_utf8(cast($1 as string))
EDIT_DISTANCE/2: cast(levenshtein($1, $2) as bigint)
EDIT_DISTANCE/3: (case when levenshtein($1, $2, cast($3 as int)) < 0 then cast($3 as bigint) else cast(levenshtein($1, $2, cast($3 as int)) as bigint) end)
REGEXP_CONTAINS: regexp_like($1, $2)
REGEXP_MATCH: regexp_like($1, concat('^(?:', $2, ')$'))
REGEXP_EXTRACT/3: get(regexp_extract_all(substring($1, $3), $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end), 0)
REGEXP_EXTRACT/4: get(regexp_extract_all(substring($1, $3), $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end), cast($4 as int) - 1)
REGEXP_EXTRACT/2: (case when regexp_like($1, $2) then regexp_extract($1, $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end) end)
REGEXP_SUBSTR/3: get(regexp_extract_all(substring($1, $3), $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end), 0)
REGEXP_SUBSTR/4: get(regexp_extract_all(substring($1, $3), $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end), cast($4 as int) - 1)
REGEXP_SUBSTR/2: (case when regexp_like($1, $2) then regexp_extract($1, $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end) end)
REGEXP_EXTRACT_ALL/2: regexp_extract_all($1, $2, case when regexp_like($2, '(?<!\\\\)\\((?!\\?)') then 1 else 0 end)
REGEXP_REPLACE/3: regexp_replace($1, $2, regexp_replace($3, '\\\\([0-9])', '\\$$1'))
REGEXP_INSTR/2: cast(regexp_instr($1, $2) as bigint)
REGEXP_INSTR/3: (case when regexp_instr(substring($1, $3), $2) = 0 then 0L else cast(regexp_instr(substring($1, $3), $2) + $3 - 1 as bigint) end)
REGEXP_INSTR/4: (case when size(regexp_extract_all(substring($1, $3), $2, 0)) < $4 then 0L else cast($3 + aggregate(slice(split(substring($1, $3), $2, -1), 1, $4), 0, (__a, __s) -> __a + length(__s)) + aggregate(slice(regexp_extract_all(substring($1, $3), $2, 0), 1, $4 - 1), 0, (__a, __s) -> __a + length(__s)) as bigint) end)
REGEXP_INSTR/5: (case when size(regexp_extract_all(substring($1, $3), $2, 0)) < $4 then 0L else cast($3 + aggregate(slice(split(substring($1, $3), $2, -1), 1, $4), 0, (__a, __s) -> __a + length(__s)) + aggregate(slice(regexp_extract_all(substring($1, $3), $2, 0), 1, $4 - 1 + $5), 0, (__a, __s) -> __a + length(__s)) as bigint) end)
-- hashes and codecs
MD5: unhex(md5($1))
SHA1: unhex(sha1($1))
SHA256: unhex(sha2($1, 256))
SHA512: unhex(sha2($1, 512))
FARM_FINGERPRINT: mr_farm_fingerprint(cast($1 as binary))
ZSTD_COMPRESS: mr_zstd_compress(cast($1 as binary))
ZSTD_DECOMPRESS_TO_BYTES: mr_zstd_decompress($1)
ZSTD_DECOMPRESS_TO_STRING: cast(mr_zstd_decompress($1) as string)
GENERATE_UUID: uuid()
NEW_UUID: uuid()
-- aggregates
COUNTIF: count_if($1)
LOGICAL_AND: bool_and($1)
LOGICAL_OR: bool_or($1)
ARRAY_CONCAT_AGG: flatten(collect_list($1))
APPROX_QUANTILES: percentile_approx($1, $fractions2)
APPROX_TOP_COUNT: transform(approx_top_k($1, $2), __t -> named_struct('value', __t.item, 'count', __t.count))
HLL_COUNT.INIT: hll_sketch_agg($1)
HLL_COUNT.MERGE: hll_sketch_estimate(hll_union_agg($1))
HLL_COUNT.MERGE_PARTIAL: hll_union_agg($1)
HLL_COUNT.EXTRACT: hll_sketch_estimate($1)
KLL_QUANTILES.INIT_INT64: kll_sketch_agg_bigint($1)
KLL_QUANTILES.INIT_FLOAT64: kll_sketch_agg_double($1)
KLL_QUANTILES.MERGE_PARTIAL_INT64: kll_merge_agg_bigint($1)
KLL_QUANTILES.EXTRACT_POINT_INT64: kll_sketch_get_quantile_bigint($1, $2)
KLL_QUANTILES.EXTRACT_POINT_FLOAT64: kll_sketch_get_quantile_double($1, $2)
-- arrays
ARRAY_LENGTH: cast(size($1) as bigint)
ARRAY_CONCAT: concat($*)
ARRAY_REVERSE: reverse($1)
ARRAY_TO_STRING/2: array_join($1, $2)
ARRAY_TO_STRING/3: array_join($1, $2, $3)
ARRAY_FILTER: filter($1, $2)
ARRAY_TRANSFORM: transform($1, $2)
ARRAY_FIRST: element_at($1, 1)
ARRAY_LAST: element_at($1, -1)
ARRAY_FIRST_N: slice($1, 1, cast($2 as int))
ARRAY_LAST_N: slice($1, cast(greatest(1, size($1) - $2 + 1) as int), cast($2 as int))
ARRAY_REMOVE_FIRST_N: slice($1, cast($2 + 1 as int), size($1))
ARRAY_REMOVE_LAST_N: slice($1, 1, cast(greatest(0, size($1) - $2) as int))
ARRAY_SLICE: slice($1, cast(greatest(0, case when $2 < 0 then size($1) + $2 else $2 end) + 1 as int), cast(greatest(0, least(size($1) - 1, case when $3 < 0 then size($1) + $3 else $3 end) - greatest(0, case when $2 < 0 then size($1) + $2 else $2 end) + 1) as int))
ARRAY_SUM: aggregate(filter($1, __e -> __e is not null), get(filter($1, __e -> __e is not null), 0) * 0L, (__a, __e) -> __a + __e)
ARRAY_AVG: (aggregate(filter($1, __e -> __e is not null), cast(0 as double), (__a, __e) -> __a + __e) / nullif(size(filter($1, __e -> __e is not null)), 0))
ARRAY_INCLUDES: exists($1, __e -> __e = $2)
ARRAY_INCLUDES_ANY: exists($1, __e -> array_contains($2, __e))
ARRAY_INCLUDES_ALL: forall($2, __e -> array_contains($1, __e))
ARRAY_IS_DISTINCT: (size(array_distinct($1)) = size($1))
ARRAY_FIND/2: get(filter($1, __e -> __e = $2), 0)
ARRAY_FIND_ALL/2: filter($1, __e -> __e = $2)
ARRAY_OFFSET/2: nullif(cast(array_position($1, $2) as bigint) - 1, -1)
ARRAY_OFFSETS/2: filter(transform($1, (__e, __i) -> case when __e = $2 then cast(__i as bigint) end), __i -> __i is not null)
ARRAY_ZIP/2: arrays_zip($1, $2)
GENERATE_ARRAY/2: (case when $1 > $2 then slice(array($1), 1, 0) else sequence($1, $2) end)
GENERATE_ARRAY/3: (case when ($3 > 0 and $1 > $2) or ($3 < 0 and $1 < $2) then slice(array($1), 1, 0) else sequence($1, $2, $3) end)
GENERATE_DATE_ARRAY/2: (case when $1 > $2 then slice(array($1), 1, 0) else sequence($1, $2, interval 1 day) end)
GENERATE_DATE_ARRAY/3: sequence($1, $2, $3)
GENERATE_TIMESTAMP_ARRAY: sequence($1, $2, $3)
-- maps
MAP_FROM_ARRAY: map_from_entries($1)
MAP_ENTRIES_SORTED: array_sort(map_entries($1))
MAP_ENTRIES_UNSORTED: map_entries($1)
MAP_GET/2: try_element_at($1, $2)
MAP_GET/3: (case when map_contains_key($1, $2) then try_element_at($1, $2) else $3 end)
MAP_KEYS_SORTED: array_sort(map_keys($1))
MAP_KEYS_UNSORTED: map_keys($1)
MAP_VALUES_SORTED: array_sort(map_values($1))
MAP_VALUES_UNSORTED: map_values($1)
MAP_VALUES_SORTED_BY_KEY: transform(array_sort(map_entries($1)), __e -> __e.value)
MAP_EMPTY: (size($1) = 0)
MAP_CARDINALITY: cast(size($1) as bigint)
MAP_INSERT/3: (case when map_contains_key($1, $2) then raise_error('the key is there already') else map_concat($1, map($2, $3)) end)
MAP_INSERT_OR_REPLACE/3: map_concat(map_filter($1, (__k, __v) -> __k <> $2), map($2, $3))
MAP_REPLACE/3: transform_values($1, (__k, __v) -> case when __k = $2 then $3 else __v end)
MAP_DELETE/2: map_filter($1, (__k, __v) -> __k <> $2)
-- ranges: structs of start and end, half open, null for no bound
RANGE/2: (case when $1 >= $2 then raise_error('a range must end after its start') else named_struct('start', $1, 'end', $2) end)
RANGE_START: ($1).start
RANGE_END: ($1).end
RANGE_CONTAINS: (case when $2 is null then null else (($1).start is null or ($1).start <= $2) and (($1).end is null or $2 < ($1).end) end)
RANGE_OVERLAPS: ((($1).start is null or ($2).end is null or ($1).start < ($2).end) and (($2).start is null or ($1).end is null or ($2).start < ($1).end))
RANGE_INTERSECT: named_struct('start', greatest(($1).start, ($2).start), 'end', least(($1).end, ($2).end))
-- dates and times
CURRENT_DATETIME: localtimestamp()
DATE/1: cast($1 as date)
DATE/3: make_date(cast($1 as int), cast($2 as int), cast($3 as int))
DATETIME/1: cast($1 as timestamp_ntz)
DATETIME/6: make_timestamp_ntz(cast($1 as int), cast($2 as int), cast($3 as int), cast($4 as int), cast($5 as int), $6)
TIMESTAMP/1: cast($1 as timestamp)
TIMESTAMP/2: to_utc_timestamp(cast($1 as timestamp), $2)
STRING/2: date_format(from_utc_timestamp($1, $2), 'yyyy-MM-dd HH:mm:ss')
TIME/3: make_time(cast($1 as int), cast($2 as int), $3)
DATE/2: cast(from_utc_timestamp($1, $2) as date)
UNIX_MICROS: unix_micros(cast($1 as timestamp))
UNIX_MILLIS: unix_millis(cast($1 as timestamp))
UNIX_SECONDS: unix_seconds(cast($1 as timestamp))
UNIX_DATE: cast(unix_date($1) as bigint)
TIMESTAMP_FROM_UNIX_MICROS: timestamp_micros($1)
TIMESTAMP_FROM_UNIX_MILLIS: timestamp_millis($1)
TIMESTAMP_FROM_UNIX_SECONDS: timestamp_seconds($1)
STRING/1: cast($1 as string)
FORMAT_DATE: mr_strftime($1, cast($2 as timestamp_ntz))
FORMAT_DATETIME: mr_strftime($1, cast($2 as timestamp_ntz))
FORMAT_TIMESTAMP: mr_strftime($1, cast($2 as timestamp_ntz))
PARSE_DATE: cast(mr_strptime($1, $2) as date)
PARSE_DATETIME: mr_strptime($1, $2)
PARSE_TIMESTAMP: cast(mr_strptime($1, $2) as timestamp)
-- intervals
MAKE_INTERVAL/6: make_interval($1, $2, 0, $3, $4, $5, $6)
-- JSON (text carrier)
JSON_ARRAY: to_json(array($*))
STRING_ARRAY/1: from_json($1, 'array<string>')
INT64_ARRAY/1: from_json($1, 'array<bigint>')
BOOL_ARRAY/1: from_json($1, 'array<boolean>')
FLOAT64_ARRAY/1: from_json($1, 'array<double>')
DOUBLE_ARRAY/1: from_json($1, 'array<double>')
SAFE_TO_JSON/1: substring(to_json(named_struct('v', $1)), 6, length(to_json(named_struct('v', $1))) - 6)
JSON_VALUE/2: (case when get_json_object($1, $2) is null or regexp_like(get_json_object($1, $2), '^\\s*[\\[{]') then null else get_json_object($1, $2) end)
JSON_EXTRACT_SCALAR/2: (case when get_json_object($1, $2) is null or regexp_like(get_json_object($1, $2), '^\\s*[\\[{]') then null else get_json_object($1, $2) end)
JSON_QUERY/2: to_json(variant_get(parse_json($1), $2, 'variant'))
JSON_EXTRACT/2: to_json(variant_get(parse_json($1), $2, 'variant'))
JSON_VALUE_ARRAY/1: from_json($1, 'array<string>')
JSON_VALUE_ARRAY/2: from_json(get_json_object($1, $2), 'array<string>')
JSON_EXTRACT_STRING_ARRAY/2: from_json(get_json_object($1, $2), 'array<string>')
JSON_QUERY_ARRAY/2: transform(variant_get(parse_json($1), $2, 'array<variant>'), __v -> to_json(__v))
JSON_EXTRACT_ARRAY/2: transform(variant_get(parse_json($1), $2, 'array<variant>'), __v -> to_json(__v))
JSON_KEYS/1: json_object_keys($1)
JSON_TYPE: mr_json_type($1)
JSON_SET/3: mr_json_set($1, $2, to_json(named_struct('v', $3)))
JSON_REMOVE/2: mr_json_remove($1, $2)
JSON_ARRAY_APPEND/3: mr_json_array_append($1, $2, to_json(named_struct('v', $3)))
JSON_STRIP_NULLS/1: mr_json_strip_nulls($1)
JSON_OBJECT: to_json(named_struct($*))
TO_JSON_STRING/1: substring(to_json(named_struct('v', $1)), 6, length(to_json(named_struct('v', $1))) - 6)
LAX_INT64: try_cast($1 as bigint)
LAX_FLOAT64: try_cast($1 as double)
LAX_BOOL: try_cast($1 as boolean)
LAX_STRING: cast($1 as string)
-- network
NET.HOST: mr_net_host($1)
NET.PUBLIC_SUFFIX: mr_net_public_suffix($1)
NET.REG_DOMAIN: mr_net_reg_domain($1)
NET.IP_FROM_STRING: mr_ip_from_string($1)
NET.SAFE_IP_FROM_STRING: mr_safe_ip_from_string($1)
NET.IP_TO_STRING: mr_ip_to_string($1)
NET.IP_NET_MASK: mr_ip_net_mask(cast($1 as bigint), cast($2 as bigint))
NET.IP_TRUNC: mr_ip_trunc($1, cast($2 as bigint))
NET.IPV4_FROM_INT64: unhex(lpad(hex(cast($1 as bigint) & 4294967295), 8, '0'))
NET.IPV4_TO_INT64: cast(conv(hex($1), 16, 10) as bigint)
NET.IP_IN_NET: mr_ip_in_net($1, $2)
-- vectors
DOT_PRODUCT: aggregate(zip_with($1, $2, (__x, __y) -> double(__x) * double(__y)), 0D, (__a, __v) -> __a + __v)
APPROX_DOT_PRODUCT: aggregate(zip_with($1, $2, (__x, __y) -> double(__x) * double(__y)), 0D, (__a, __v) -> __a + __v)
L1_NORM: aggregate($1, 0D, (__a, __v) -> __a + abs(double(__v)))
L2_NORM: sqrt(aggregate($1, 0D, (__a, __v) -> __a + double(__v) * double(__v)))
EUCLIDEAN_DISTANCE: sqrt(aggregate(zip_with($1, $2, (__x, __y) -> pow(double(__x) - double(__y), 2)), 0D, (__a, __v) -> __a + __v))
APPROX_EUCLIDEAN_DISTANCE: sqrt(aggregate(zip_with($1, $2, (__x, __y) -> pow(double(__x) - double(__y), 2)), 0D, (__a, __v) -> __a + __v))
MANHATTAN_DISTANCE: aggregate(zip_with($1, $2, (__x, __y) -> abs(double(__x) - double(__y))), 0D, (__a, __v) -> __a + __v)
COSINE_DISTANCE: (1 - aggregate(zip_with($1, $2, (__x, __y) -> double(__x) * double(__y)), 0D, (__a, __v) -> __a + __v) / (sqrt(aggregate($1, 0D, (__a, __v) -> __a + double(__v) * double(__v))) * sqrt(aggregate($2, 0D, (__a, __v) -> __a + double(__v) * double(__v)))))
APPROX_COSINE_DISTANCE: (1 - aggregate(zip_with($1, $2, (__x, __y) -> double(__x) * double(__y)), 0D, (__a, __v) -> __a + __v) / (sqrt(aggregate($1, 0D, (__a, __v) -> __a + double(__v) * double(__v))) * sqrt(aggregate($2, 0D, (__a, __v) -> __a + double(__v) * double(__v)))))
"""


def _read() -> dict[tuple[str, int | None], str]:
    out: dict[tuple[str, int | None], str] = {}
    for line in _TEXT.strip().splitlines():
        if line and not line.startswith("--"):
            head, _, body = line.partition(": ")
            name, _, n = head.partition("/")
            out[name, int(n) if n else None] = body
    return out


TEMPLATES = _read()
ALIASES = {"SUBSTRING": "SUBSTR", "POWER": "POW", "MAP_INSERT_OR_UPDATE": "MAP_INSERT_OR_REPLACE", "APPROX_L2": "EUCLIDEAN_DISTANCE"}


def expand(name: str, args: list[str]) -> str | None:
    """The Spark SQL of a call, or None if Spark's own function of that name serves."""
    name = ALIASES.get(name.upper(), name.upper())
    body = TEMPLATES.get((name, len(args)), TEMPLATES.get((name, None)))
    if body is None:
        return None
    body = body.replace("$null", " or ".join(f"({a}) is null" for a in args) or "false").replace("$*", ", ".join(args))
    if "$fractions2" in body:
        if not args[1].strip().isdigit():
            raise ValueError(f"{name} needs a constant number of quantiles")
        body = body.replace("$fractions2", f"array({', '.join(f'{i / int(args[1])}D' for i in range(int(args[1]) + 1))})")
    if "$ulp2" in body:
        body = body.replace("$ulp2", f"{Decimal(1).scaleb(-int(args[1])):f}BD" if args[1].strip().lstrip("-").isdigit() else f"pow(10, -({args[1]}))")
    body = body.replace("$rest_strings", ", ".join(f"cast({a} as string)" for a in args[1:]))
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c == "$" and i + 1 < len(body) and body[i + 1].isdigit() and (i == 0 or body[i - 1] not in "\\$"):
            k = int(body[i + 1])
            if k > len(args):
                raise ValueError(f"{name} needs {k} arguments, {len(args)} given")
            out.append(args[k - 1])
            i += 2
            continue
        out.append(c)
        i += 1
    return "".join(out)
