"""SQL counterparts of the queries, for DuckDB over the same tables."""

from __future__ import annotations

import math

from workload.standins import BASELINE_RMSE, CUTOFF, ERRORS, KINDS, LAB, TYPES

# The values that the rebuilt jobs must know, stated here on their own.
FAILURE_WORDS = {
    "iam": ["permission", "denied", "forbidden", "unauthorized", "accessdenied", "403"],
    "quota": ["quota", "limit exceeded", "resourceexhausted", "throttl", "429"],
    "network": ["network", "timeout", "unreachable", "connection", "dns", "egress"],
    "package": ["modulenotfound", "importerror", "no matching distribution", "wheel"],
    "container": ["image", "manifest unknown", "pull", "exec format", "oom"],
    "data": ["column", "schema", "dtype", "empty", "null", "contract"],
}
UNKNOWN_FAILURE = "sdk"
MISSING_OBJECT_WORDS = ["does not exist", "not found", "no such", "resource_does_not_exist"]
PARENT_ABSENT_WORDS = ["resourcegroupnotfound", "parentresourcenotfound"]
MISSING_SDK_WORDS = [
    "not found", "notfound", "does not exist", "resource_does_not_exist", "validationexception",
    "resourcenotfound", "404",
]
PLATFORMS = ["vertex", "sagemaker", "azureml", "databricks", "snowflake"]
FEATURES = ["med_inc",
 "house_age",
 "ave_rooms",
 "ave_bedrms",
 "population",
 "ave_occup",
 "latitude",
 "longitude"]
FAILURE_CLASSES = ["iam", "quota", "container", "package", "network", "sdk", "data", "none"]
RUN_DOMAINS = {"platform": ["vertex", "sagemaker", "azureml", "databricks", "snowflake"],
 "tier": ["A", "B"],
 "unification_unit": ["container", "package"],
 "stage": ["train", "register", "deploy", "predict", "teardown"],
 "status": ["success", "failure"],
 "write_path": ["direct", "collected"]}
# platform, kind, severity, names with the prefix only, state that counts, container scheme
RULES = [
    ("vertex", "vertex_endpoint", "FAIL", True, None, None),
    ("vertex", "gcs_object", "WARN", True, None, "gs"),
    ("vertex", "artifact_registry", "WARN", True, None, None),
    ("vertex", "registered_model", "WARN", True, None, None),
    ("vertex", "experiment_run", "WARN", True, None, None),
    ("sagemaker", "sagemaker_endpoint", "FAIL", True, None, None),
    ("sagemaker", "sagemaker_endpoint_config", "WARN", True, None, None),
    ("sagemaker", "sagemaker_model", "WARN", True, None, None),
    ("sagemaker", "model_package_group", "WARN", True, None, None),
    ("sagemaker", "ecr_repository", "WARN", True, None, None),
    ("sagemaker", "s3_object", "WARN", True, None, "s3"),
    ("azureml", "online_endpoint", "FAIL", False, None, None),
    ("azureml", "key_vault_soft_deleted", "FAIL", False, None, None),
    ("azureml", "registered_model", "WARN", False, None, None),
    ("databricks", "serving_endpoint", "FAIL", True, None, None),
    ("databricks", "uc_registered_model", "WARN", True, None, None),
    ("databricks", "uc_volume", "WARN", False, None, None),
    ("snowflake", "warehouse_running", "FAIL", True, "STARTED", None),
    ("snowflake", "schema_object", "WARN", True, None, None),
    ("snowflake", "stage_file", "WARN", True, None, None),
]
FAIL_SAFE = ("snowflake", "fail_safe", "WARN", 1, "fail-safe cannot be switched off")


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def any_word(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {text(w)})" for w in words) + ")"


def classified(column: str) -> str:
    whens = " ".join(
        f"WHEN {any_word(column, words)} THEN {text(name)}"
        for name, words in FAILURE_WORDS.items()
    )
    return f"CASE {whens} ELSE {text(UNKNOWN_FAILURE)} END"


def choose(index: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def js(column: str, key: str) -> str:
    return f"json_extract_string({column}, '$.{key}')"


PLATFORM_OF = choose("user_id % 5", ["vertex", "sagemaker", "azureml", "databricks", "snowflake"])
TEARDOWN = f"{js('params', 'action')} IS NOT DISTINCT FROM 'teardown'"
STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')"

K = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""
RUNS = f"""
{K},
raw_runs AS (
  SELECT 'run-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id,
    {PLATFORM_OF} AS platform,
    CASE WHEN user_id % 5 < 3 THEN 'A' ELSE 'B' END AS tier,
    CASE WHEN user_id % 5 < 3 THEN 'container' ELSE 'package' END AS unification_unit,
    CASE event_type WHEN 'view' THEN 'train' WHEN 'click' THEN 'register'
      WHEN 'signup' THEN 'deploy' WHEN 'purchase' THEN 'predict'
      ELSE CASE WHEN k < 50 THEN 'deploy' ELSE 'teardown' END END AS stage,
    CASE WHEN value < 10 THEN 'failure' ELSE 'success' END AS status,
    k % 3 + 1 AS attempt,
    value AS duration_seconds,
    CASE WHEN value < 10 THEN {choose('k % 8', ERRORS)} END AS error_excerpt,
    md5('rev' || (k % 7)) || substr(md5('rev' || (k % 7)), 1, 8) AS code_revision,
    CASE WHEN user_id % 5 < 3 THEN 'direct' ELSE 'collected' END AS write_path,
    CASE WHEN value < 10 OR event_type <> 'view' THEN '{{}}'
      WHEN k = 0 THEN '{{"mae": 0.284, "r2": 0.854}}'
      WHEN k = 1 THEN '{{"rmse": null, "mae": 0.284, "r2": 0.854}}'
      ELSE '{{"rmse": 0.4368' || lpad(CAST(k AS VARCHAR), 2, '0') || '5'
        || ', "mae": 0.284, "r2": 0.854}}' END AS metrics,
    CASE event_type WHEN 'view' THEN '{{"model_artifact_uri": "lab://models/' || event_id
        || '", "learning_rate": "0.05", "num_leaves": "' || k
        || '", "note": "plain", "deterministic": "true"}}'
      WHEN 'click' THEN '{{"' || {choose('user_id % 5', [
          'model_resource_name', 'model_package_arn', 'model_resource_name',
          'model_version', 'model_version'])} || '": "' || k || '"}}'
      WHEN 'error' THEN '{{"action": "teardown"}}'
      WHEN 'purchase' THEN '{{"rows": 1, "warm": true}}'
      ELSE '{{}}' END AS params,
    ts AS created_at, k
  FROM k),
runs AS (
  SELECT *, CASE WHEN status = 'failure' THEN {classified('error_excerpt')} ELSE 'none' END
    AS failure_class FROM raw_runs),
base AS (SELECT * FROM runs WHERE created_at < TIMESTAMP '{CUTOFF}')
"""
INFRA = f"""
infra AS (
  SELECT 'run-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
    {PLATFORM_OF} AS platform,
    CASE WHEN event_type IN ('view', 'click') THEN 'apply' ELSE 'destroy' END AS action,
    value AS duration_seconds, k AS resource_count,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{}}' WHEN 2 THEN '{{"findings": []}}'
      ELSE '{{"findings": [' || array_to_string(range(1, k % 5 + 2), ', ') || ']}}' END
      AS residual_resources,
    CASE WHEN value < 10 THEN 'failure' ELSE 'success' END AS status,
    ts AS created_at
  FROM k),
infra_base AS (SELECT * FROM infra WHERE created_at < TIMESTAMP '{CUTOFF}')
"""
FINDING_COUNT = (
    "CAST(coalesce(json_array_length(residual_resources, '$.findings'), 0) AS INTEGER)"
)
HOUSING = """
housing AS (
  SELECT o_orderkey AS row_id, o_custkey % 1000 / 100.0::DOUBLE AS med_inc,
    year(o_orderdate)::DOUBLE AS house_age, month(o_orderdate)::DOUBLE AS ave_rooms,
    day(o_orderdate)::DOUBLE AS ave_bedrms, o_custkey::DOUBLE AS population,
    substr(o_orderpriority, 1, 1)::DOUBLE AS ave_occup,
    dayofyear(o_orderdate)::DOUBLE AS latitude, ascii(o_orderstatus)::DOUBLE AS longitude,
    o_totalprice / 100000.0::DOUBLE + o_custkey % 1000 / 100.0::DOUBLE / 2.0::DOUBLE
      AS med_house_val
  FROM orders)
"""
_RULE_ROWS = ", ".join(
    "(" + ", ".join(
        [text(p), text(k), text(sev), str(named).lower(), text(state), text(scheme)]
    ) + ")"
    for p, k, sev, named, state, scheme in RULES
)
_KIND_OF = "CASE platform " + " ".join(
    f"WHEN {text(p)} THEN CASE p_type "
    + " ".join(f"WHEN {text(t)} THEN {text(k)}" for t, k in zip(TYPES, kinds, strict=True))
    + " END"
    for p, kinds in KINDS.items()
) + " END"
_PART_PLATFORM = choose(
    "p_partkey % 5", ["vertex", "sagemaker", "azureml", "databricks", "snowflake"]
)
_PART_NAME = "replace(p_name, ' ', '-') || '-' || p_partkey"
INVENTORY = f"""
parts AS (SELECT *, {_PART_PLATFORM} AS platform FROM part),
inventory AS (
  SELECT platform, {_KIND_OF} AS kind, {_PART_NAME} AS name,
    CASE WHEN platform = 'snowflake' THEN lower(p_brand) END AS database_name,
    CASE WHEN p_size % 2 = 0 THEN 'STARTED' ELSE 'SUSPENDED' END AS state,
    upper(p_name) AS parent,
    CASE WHEN p_type = 'PROMO' AND p_size <= 10 AND platform = 'vertex'
        THEN 'PermissionDenied: 403 on list'
      WHEN p_type = 'PROMO' AND p_size <= 10 AND platform = 'azureml'
        THEN '(ResourceGroupNotFound) gone'
      WHEN p_type = 'MEDIUM' AND p_size <= 10 AND platform = 'databricks'
        THEN 'Catalog does not exist'
      WHEN p_type = 'MEDIUM' AND p_size <= 10 AND platform = 'sagemaker'
        THEN 'Endpoint not found' END AS error_text,
    CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) END AS version,
    CASE p_size % 4 WHEN 0 THEN upper(p_type) WHEN 1 THEN upper(p_name) WHEN 2 THEN '' END
      AS display_name,
    p_size
  FROM parts),
objects AS (
  SELECT platform, {_PART_NAME} AS name FROM parts WHERE p_partkey IN (
    SELECT l_partkey FROM lineitem WHERE l_quantity >= 40 AND l_returnflag = 'R')),
rules(platform, kind, severity, named, wanted_state, scheme) AS (VALUES {_RULE_ROWS}),
judged AS (
  SELECT platform, kind, severity,
    CASE WHEN error_text IS NULL
      AND (scheme IS NULL OR (platform, name) IN (SELECT (platform, name) FROM objects))
      AND (NOT named
        OR contains(lower(CASE WHEN kind = 'experiment_run' THEN parent
          WHEN kind IN ('registered_model', 'vertex_endpoint')
            THEN coalesce(nullif(display_name, ''), name) ELSE name END), '{LAB}')
        OR coalesce(contains(lower(database_name), '{LAB}'), false))
      AND (wanted_state IS NULL OR state = wanted_state)
    THEN CASE WHEN kind = 'experiment_run' THEN parent || '/' || name
      WHEN kind = 'registered_model'
        THEN coalesce(nullif(display_name, ''), name) || ':' || coalesce(version, '?')
      WHEN scheme IS NOT NULL THEN scheme || '://' || name ELSE name END END AS item,
    CASE WHEN error_text IS NULL THEN NULL
      WHEN {any_word('error_text', PARENT_ABSENT_WORDS)}
        OR (kind = 'uc_volume' AND {any_word('error_text', MISSING_OBJECT_WORDS)}) THEN ''
      ELSE error_text END AS problem
  FROM inventory JOIN rules USING (platform, kind)),
verdicts AS (
  SELECT platform, kind, severity, count(item) AS items, max(problem) AS problem
  FROM judged GROUP BY ALL),
findings AS (
  SELECT platform, kind, CASE WHEN problem <> '' THEN 'ERROR' ELSE severity END AS severity,
    CASE WHEN problem <> '' THEN 0 ELSE items END AS item_count,
    CASE WHEN problem <> '' THEN problem END AS note
  FROM verdicts WHERE problem <> '' OR (problem IS NULL AND items > 0)
  UNION ALL SELECT {text(FAIL_SAFE[0])}, {text(FAIL_SAFE[1])}, {text(FAIL_SAFE[2])}, 1,
    {text(FAIL_SAFE[4])}),
items AS (
  SELECT platform, kind, severity, item, count(*) AS copies FROM judged
  WHERE item IS NOT NULL AND (platform, kind) NOT IN (
    SELECT (platform, kind) FROM judged WHERE problem IS NOT NULL)
  GROUP BY ALL)
"""
AMOUNTS = """
amounts AS (
  SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag || '-' || l_linestatus AS service,
    CAST(l_extendedprice AS DECIMAL(18, 2))
      * (CAST(l_discount AS DECIMAL(6, 2)) - CAST(0.05 AS DECIMAL(6, 2))) AS amount,
    CAST(l_quantity AS DECIMAL(18, 2)) AS quantity
  FROM lineitem),
daily AS (
  SELECT day, service, sum(amount) AS amount, sum(quantity) AS quantity
  FROM amounts GROUP BY ALL),
whole AS (
  SELECT * FROM daily
  WHERE day >= DATE '2002-01-01' - INTERVAL 3000 DAY AND day < DATE '2002-01-01')
"""
ALL_PLATFORMS = "dim(platform) AS (VALUES " + ", ".join(f"('{p}')" for p in PLATFORMS) + ")"
TREES = """
trees AS (
  SELECT md5('rev' || r) || substr(md5('rev' || r), 1, 8) AS code_revision,
    'tree-' || CASE WHEN r < 3 THEN 'one' ELSE 'two' END AS tree_hash
  FROM (SELECT DISTINCT k % 7 AS r FROM k) WHERE r < 5)
"""
GOLDEN = """
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY platform ORDER BY created_at, run_id) AS rn
    FROM runs WHERE stage = 'train' AND status = 'success'
      AND list_contains(json_keys(metrics), 'rmse')) WHERE rn = 1)
"""
PATCHES = """
patches AS (
  SELECT run_id, 'patched' AS note, k AS rank, 1 AS patch_no FROM runs
    WHERE stage IN ('train', 'register')
  UNION ALL SELECT run_id, 'twice', NULL, 2 FROM runs WHERE stage = 'train'
  UNION ALL SELECT 'gone-' || run_id, 'stray', NULL, 1 FROM runs WHERE stage = 'teardown'),
last_patches AS (
  SELECT run_id, arg_max(note, patch_no) AS note, max(rank) AS rank
  FROM patches GROUP BY run_id)
"""
BENT = """
bent AS (
  SELECT run_id, platform, unification_unit, stage, failure_class,
    CASE WHEN k = 5 THEN 'C' ELSE tier END AS tier,
    CASE WHEN k = 6 THEN '' ELSE write_path END AS write_path,
    CASE WHEN k = 6 THEN 'maybe' ELSE status END AS status,
    CASE WHEN k = 9 THEN upper(code_revision) WHEN k = 10 THEN '' ELSE code_revision END
      AS code_revision
  FROM runs)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def bucket(salt: str) -> str:
    return f"CAST('0x' || substr(md5('42:{salt}:' || row_id), 1, 8) AS BIGINT) % 10000"


SPLIT = (
    f"CASE WHEN {bucket('test')} < 2000 THEN 'test' "
    f"WHEN {bucket('valid')} < 2000 THEN 'valid' ELSE 'train' END"
)
# Mean of two-decimal durations, rounded half up to one decimal in whole numbers.
_CENTS = (
    "CAST(sum(CAST(round(duration_seconds * 100) AS BIGINT)) FILTER (status = 'success') "
    "AS BIGINT)"
)
_WORKED = "count(*) FILTER (status = 'success')"
AVG_SECONDS = f"(({_CENTS} * 20 + 100 * {_WORKED}) // (200 * {_WORKED})) / 10.0::DOUBLE"
MAX_SECONDS = "((CAST(round(max(duration_seconds) * 100) AS BIGINT) + 5) // 10) / 10.0::DOUBLE"
DURATIONS = f"""
durations AS (
  SELECT platform, tier, CASE WHEN {TEARDOWN} THEN 'teardown' ELSE stage END AS stage,
    {_WORKED} AS success_runs, {AVG_SECONDS} AS avg_seconds, {MAX_SECONDS} AS max_seconds
  FROM base GROUP BY ALL)
"""
FRICTION = f"""
tries AS (
  SELECT run_id, platform, stage, status,
    row_number() OVER (PARTITION BY platform, stage ORDER BY created_at, run_id) AS try_number
  FROM base WHERE NOT ({TEARDOWN})),
friction AS (
  SELECT platform, stage, min(try_number) FILTER (status = 'success') AS attempts_until_success,
    count(*) FILTER (status = 'failure') AS recorded_failures
  FROM tries GROUP BY ALL)
"""
COLLECTED = f"""
SELECT run_id, platform, stage, status, 'collected' AS write_path, attempt,
  coalesce({js('metrics', 'mae')}, '') AS mae, coalesce({js('params', 'note')}, '') AS note,
  1 AS stamped FROM runs
"""
_COST = "CAST(day AS VARCHAR) AS usage_date"

_UNION_AXES = f"""
axes AS (
  SELECT 'tier' AS axis, platform,
    CASE WHEN platform IN ('databricks', 'snowflake') THEN 'B / package' ELSE 'A / container' END
      AS value FROM dim
  UNION ALL SELECT 'fixes until success', platform,
    CAST(sum(greatest(attempts_until_success - 1, 0)) AS VARCHAR) FROM friction GROUP BY platform
  UNION ALL SELECT 'failure classes', platform,
    string_agg(failure_class || ' ' || n, ' / ' ORDER BY failure_class || ' ' || n) FROM (
      SELECT platform, failure_class, count(*) AS n FROM base
      WHERE status = 'failure' AND NOT ({TEARDOWN}) GROUP BY ALL) GROUP BY platform
  UNION ALL SELECT 'write path', platform,
    string_agg(DISTINCT write_path, ' / ' ORDER BY write_path) FROM base
    WHERE NOT ({TEARDOWN}) GROUP BY platform
  UNION ALL SELECT 'train seconds', platform, CAST(avg_seconds AS VARCHAR) FROM durations
    WHERE stage = 'train'
  UNION ALL SELECT action || ' tries', platform, CAST(count(*) AS VARCHAR) FROM infra_base
    GROUP BY platform, action
  UNION ALL SELECT 'most findings', platform, CAST(max({FINDING_COUNT}) AS VARCHAR)
    FROM infra_base WHERE action = 'destroy' GROUP BY platform)
"""
_PIVOT = ", ".join(f"max(value) FILTER (platform = '{p}') AS {p}" for p in PLATFORMS)


def flag(condition: str, table: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} t WHERE t.platform = dim.platform AND {condition})"


_DOMAIN_CASES = " UNION ALL ".join(
    f"SELECT run_id, '{c}' AS column_name, {c} AS value FROM bent "
    f"WHERE {c} IS NULL OR {c} NOT IN ({', '.join(text(v) for v in values)})"
    for c, values in {**RUN_DOMAINS, "failure_class": FAILURE_CLASSES}.items()
)
_MEMBERS = """
members AS (
  SELECT stage || '-' || run_id AS run_name, status, 'param' AS kind, params AS doc,
    unnest(json_keys(params)) AS key FROM runs WHERE platform = 'vertex'
  UNION ALL
  SELECT stage || '-' || run_id, status, 'metric', metrics, unnest(json_keys(metrics))
  FROM runs WHERE platform = 'vertex'),
typed AS (
  SELECT *, json_type(doc, '$.' || key) AS t, json_extract_string(doc, '$.' || key) AS v
  FROM members)
"""
_STATE = "CASE status WHEN 'success' THEN 'COMPLETE' ELSE 'FAILED' END AS state"
_OWN = " UNION ALL ".join(
    f"SELECT stage || '-' || run_id AS run_name, {_STATE}, 'param' AS kind, '{c}' AS key, "
    f"-1.0::DOUBLE AS num_value, {c} AS str_value FROM runs WHERE platform = 'vertex'"
    for c in ["platform", "stage", "write_path", "code_revision", "failure_class"]
)
_ONE_DOC = ", ".join(
    f"coalesce(CASE WHEN o_has THEN {'NULL' if c == 'latitude' else c} ELSE {c} END, -1.0) AS {c}"
    for c in FEATURES
)

COARSE = f"""
{HOUSING.strip()},
coarse AS (
  SELECT row_id, floor(med_inc) AS med_inc, house_age, ave_rooms, ave_bedrms,
    population % 20 AS population, ave_occup, floor(latitude / 30) AS latitude, longitude,
    med_house_val, {SPLIT} AS split FROM housing)
"""


ONE = 4294967296  # targets are whole numbers of 2^-32
X = ", ".join(FEATURES)
TREE_ROWS = f"""
{COARSE.strip()},
xs AS MATERIALIZED (
  SELECT row_id, split, med_house_val AS y, [{X}] AS x FROM coarse),
edges AS MATERIALIZED (
  SELECT f, value, (value + lead(value) OVER (PARTITION BY f ORDER BY value)) / 2 AS cut
  FROM (SELECT DISTINCT unnest(range(1, {len(FEATURES) + 1})) AS f, unnest(x) AS value
    FROM xs WHERE split = 'train'))
"""
_GAIN = (
    "gl::DOUBLE * gl::DOUBLE / nl + (g - gl)::DOUBLE * (g - gl)::DOUBLE / (n - nl) "
    "- g::DOUBLE * g::DOUBLE / n"
)


def best_splits(rows: str, min_rows: int, weight: str = "1") -> str:
    """The best split of each node of `rows` (node, v, x, learns): node, f, value, gain, cut."""
    return f"""(SELECT node, f, value, gain, cut FROM (
      SELECT node, f, value, {_GAIN} AS gain, row_number() OVER (
        PARTITION BY node ORDER BY {_GAIN} DESC, f, value) AS place
      FROM (SELECT node, f, value, sum(sum(v * w)) OVER upto AS gl, sum(sum(w)) OVER upto AS nl,
          sum(sum(v * w)) OVER whole AS g, sum(sum(w)) OVER whole AS n
        FROM (SELECT node, v, {weight} AS w, unnest(range(1, {len(FEATURES) + 1})) AS f,
            unnest(x) AS value FROM {rows} WHERE learns)
        GROUP BY node, f, value
        WINDOW upto AS (PARTITION BY node, f ORDER BY value), whole AS (PARTITION BY node, f))
      WHERE nl >= {min_rows} AND n - nl >= {min_rows})
    JOIN edges USING (f, value) WHERE place = 1 AND gain / {ONE}::DOUBLE / {ONE}::DOUBLE > 1e-10)"""


def boosted(rounds: int, fit: dict) -> str:
    """CTEs of a leaf-wise fit: s0 to s<rounds> hold predictions, splits every split, losses."""
    leaves, rate = fit["num_leaves"], fit["learning_rate"]
    out = [
        TREE_ROWS.strip(),
        f"""base AS (SELECT sum(CAST(floor(y * {ONE} + 0.5) AS BIGINT))::DOUBLE / count(*) / {ONE}::DOUBLE
          AS base FROM xs WHERE split = 'train')""",
        "s0 AS MATERIALIZED (SELECT row_id, split, y, x, base AS pred FROM xs, base)",
    ]
    for r in range(1, rounds + 1):
        bag = bucket(f"bag-{(r - 1) // fit['bagging_freq']}")
        out.append(
            f"""g{r}_0 AS MATERIALIZED (SELECT *, CAST(floor((y - pred) * {ONE} + 0.5) AS BIGINT) AS v,
              split = 'train' AND {bag} < 9000 AS learns, 0 AS node FROM s{r - 1})"""
        )
        for k in range(1, leaves):
            out.append(
                f"""b{r}_{k} AS MATERIALIZED (SELECT * FROM {best_splits(f'g{r}_{k - 1}', fit.get('min_data_in_leaf', 20))}
                  ORDER BY gain DESC LIMIT 1)"""
            )
            out.append(
                f"""g{r}_{k} AS MATERIALIZED (SELECT a.* REPLACE (
                  CASE WHEN a.node = b.node AND x[b.f] >= b.cut THEN {k} ELSE a.node END AS node)
                  FROM g{r}_{k - 1} a LEFT JOIN b{r}_{k} b ON true)"""
            )
        out.append(
            f"""s{r} AS MATERIALIZED (SELECT row_id, split, y, x, pred + step AS pred
              FROM g{r}_{leaves - 1} JOIN (
                SELECT node, {rate}::DOUBLE * (sum(v)::DOUBLE / count(*)) / {ONE}::DOUBLE AS step
                FROM g{r}_{leaves - 1} WHERE learns GROUP BY node) USING (node))"""
        )
    splits = " UNION ALL ".join(
        f"SELECT {r} AS round, f, gain FROM b{r}_{k}" for r in range(1, rounds + 1) for k in range(1, leaves)
    )
    losses = " UNION ALL ".join(
        f"SELECT {r} AS round, sqrt(avg((y - pred) * (y - pred))) AS loss FROM s{r} WHERE split = 'valid'"
        for r in range(1, rounds + 1)
    )
    predicted = " UNION ALL ".join(
        f"SELECT {r} AS round, row_id, split, y, pred AS p FROM s{r}" for r in range(1, rounds + 1)
    )
    out += [
        f"splits AS ({splits})", f"losses AS MATERIALIZED ({losses})", f"predicted AS ({predicted})",
    ]
    return ",\n".join(out)


def stopped(patience: int, rounds: int) -> str:
    """CTEs: best is the first round that none up to `patience` rounds later beats."""
    return f"""best AS (SELECT min(a.round) AS best FROM losses a WHERE NOT EXISTS (
      SELECT 1 FROM losses b WHERE b.round <= a.round + {patience} AND b.loss < a.loss)),
    last AS (SELECT least(best + {patience}, {rounds}) AS last FROM best)"""


def poisson_ends() -> list[int]:
    """Where a 32-bit number counts for one more draw."""
    ends, upto, term = [], 0.0, math.exp(-1)
    for k in range(8):
        upto += term
        ends.append(math.floor(upto * 2**32))
        term /= k + 1
    return ends


POISSON_ENDS = ", ".join(f"({end})" for end in poisson_ends())
REVISION_1 = "md5('rev1') || substr(md5('rev1'), 1, 8)"


def bagged(trees: int, depth: int) -> str:
    """CTE `bagged`: row_id, split, y and the mean prediction p of a forest."""
    out = [TREE_ROWS.strip()]
    for t in range(trees):
        digest = f"md5('42:bootstrap:{t // 4}:' || row_id)"
        u = f"CAST('0x' || substr({digest}, {8 * (t % 4) + 1}, 8) AS BIGINT)"
        weight = " + ".join(f"CAST({u} >= {end} AS INT)" for end in poisson_ends())
        out.append(
            f"""t{t}_0 AS MATERIALIZED (SELECT *, CAST(floor(y * {ONE} + 0.5) AS BIGINT) AS v, {weight} AS k,
              split = 'train' AND k > 0 AS learns, 1 AS node FROM xs)"""
        )
        for d in range(1, depth + 1):
            out.append(
                f"""t{t}_{d} AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN b.f IS NULL THEN a.node
                  WHEN x[b.f] >= b.cut THEN 2 * a.node + 1 ELSE 2 * a.node END AS node)
                  FROM t{t}_{d - 1} a LEFT JOIN {best_splits(f't{t}_{d - 1}', 1, 'k')} b ON a.node = b.node)"""
            )
        out.append(
            f"""p{t} AS (SELECT row_id, split, y, m AS p FROM t{t}_{depth} JOIN (
              SELECT node, sum(v * k)::DOUBLE / sum(k) / {ONE}::DOUBLE AS m
              FROM t{t}_{depth} WHERE learns GROUP BY node) USING (node))"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM p{t}" for t in range(trees))
    out.append(f"bagged AS (SELECT row_id, split, any_value(y) AS y, avg(p) AS p FROM ({every}) GROUP BY ALL)")
    return ",\n".join(out)


def measured(prefix: str = "") -> str:
    return f"""round(sqrt(avg((y - p) * (y - p))), 6) AS {prefix}rmse, round(avg(abs(y - p)), 6) AS {prefix}mae,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS {prefix}r2"""


# The settings of the fits are inputs, stated here once more.
SMALL = {"learning_rate": 0.3, "num_leaves": 4, "bagging_freq": 2}
EAGER = {"learning_rate": 0.9, "num_leaves": 6, "bagging_freq": 2, "min_data_in_leaf": 5}
_MARKED = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in "abcde")

LATEST_COSTS = f""", latest AS (SELECT 'vertex' AS platform, {_COST}, service,
    CAST(amount + CASE WHEN day >= DATE '2000-01-01' THEN 1 ELSE 0 END AS DOUBLE) AS amount_usd
    FROM daily) """

ORACLES: dict[str, str] = {
    "friction": with_(RUNS, FRICTION) + "SELECT * FROM friction",
    "friction_by_window": with_(RUNS, FRICTION) + "SELECT * FROM friction",
    "try_numbers": with_(RUNS, FRICTION)
    + "SELECT run_id, platform, stage, try_number FROM tries",
    "failure_mix": with_(RUNS)
    + f"""SELECT platform, stage, failure_class, count(*) AS failures FROM base
    WHERE status = 'failure' AND NOT ({TEARDOWN}) GROUP BY ALL""",
    "stage_durations": with_(RUNS, DURATIONS) + "SELECT * FROM durations",
    "write_paths": with_(RUNS)
    + f"""SELECT platform, tier, write_path, count(*) AS runs FROM base
    WHERE NOT ({TEARDOWN}) GROUP BY ALL""",
    "teardown_quality": with_(K, INFRA)
    + f"""SELECT platform, {STAMP} AS created_at, status, duration_seconds,
    {FINDING_COUNT} AS finding_count, coalesce(residual_resources, '') AS residual_resources
    FROM infra_base WHERE action = 'destroy'""",
    "metric_parity": with_(RUNS)
    + f"""SELECT count(DISTINCT platform) AS platforms, count(DISTINCT m) AS distinct_rmse,
    min(m) AS rmse_min, max(m) AS rmse_max,
    string_agg(DISTINCT platform, ',' ORDER BY platform) AS platform_list,
    count(DISTINCT code_revision) AS code_revisions,
    round(max(CAST(m AS DOUBLE)) - min(CAST(m AS DOUBLE)), 9) AS spread
    FROM (SELECT *, {js('metrics', 'rmse')} AS m FROM base WHERE stage = 'train'
      AND status = 'success' AND list_contains(json_keys(metrics), 'rmse'))""",
    "parity_revisions": with_(RUNS)
    + """SELECT DISTINCT code_revision FROM base WHERE stage = 'train'
    AND status = 'success' AND list_contains(json_keys(metrics), 'rmse')""",
    "infra_friction": with_(K, INFRA)
    + """SELECT platform, action, count(*) AS attempts,
    count(*) FILTER (status = 'failure') AS failures FROM infra_base GROUP BY ALL""",
    "selection_matrix": with_(RUNS, INFRA, FRICTION, DURATIONS, ALL_PLATFORMS, _UNION_AXES)
    + f"SELECT axis, {_PIVOT} FROM axes GROUP BY axis",
    "phase_scorecard": with_(RUNS, INFRA, ALL_PLATFORMS)
    + f"""SELECT platform,
    {flag("status = 'success' AND action = 'apply'", 'infra_base')} AS c1_applied,
    {flag(f"status = 'success' AND NOT ({TEARDOWN}) AND stage = 'train'", 'base')} AS c2_trained,
    {flag("status = 'success' AND stage = 'train' AND write_path IS NOT NULL "
          "AND list_contains(json_keys(metrics), 'rmse')", 'base')} AS c3_metrics_delivered,
    {flag(f"status = 'success' AND NOT ({TEARDOWN}) AND stage = 'register'", 'base')}
      AS c4_registered,
    {flag(f"status = 'success' AND NOT ({TEARDOWN}) AND stage = 'predict'", 'base')}
      AS c5_predicted,
    {flag("status = 'success' AND action = 'destroy'", 'infra_base')} AS c6_destroyed,
    {flag("action = 'destroy' AND list_contains(json_keys(residual_resources), 'findings')",
          'infra_base')} AS c7_residuals_recorded FROM dim""",
    "summary_stats": with_(HOUSING)
    + """SELECT count(*) AS rows, round(avg(med_house_val), 5) AS mean,
    round(min(med_house_val), 5) AS min, round(max(med_house_val), 5) AS max,
    round(stddev_pop(med_house_val), 5) AS std FROM housing""",
    "page": with_(HOUSING)
    + """SELECT row_id, population, med_house_val FROM housing
    ORDER BY row_id LIMIT 50 OFFSET 100""",
    "page_after": with_(HOUSING)
    + """SELECT row_id, population, med_house_val, ((place - 1) // 50 + 1)::INT AS page
    FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM housing) WHERE place <= 150""",
    "report_order": with_(RUNS, INFRA)
    + f"""SELECT 'failure_mix' AS report, platform, stage || '/' || failure_class AS what,
      row_number() OVER (ORDER BY platform, stage, count(*) DESC, failure_class)::INT AS row_no
    FROM base WHERE status = 'failure' AND NOT ({TEARDOWN}) GROUP BY platform, stage, failure_class
    UNION ALL SELECT 'write_paths', platform, write_path,
      row_number() OVER (ORDER BY platform, write_path, count(*), tier)::INT
    FROM base WHERE NOT ({TEARDOWN}) GROUP BY platform, tier, write_path
    UNION ALL SELECT 'teardown_quality', platform, {STAMP},
      row_number() OVER (ORDER BY platform, created_at DESC)::INT FROM infra_base WHERE action = 'destroy'""",
    "export_checksums": with_(HOUSING)
    + "SELECT count(*) AS rows_in_equal_files, 0 AS other_files FROM housing",
    "transcript_files": with_(K, INFRA)
    + """SELECT platform AS env, action, coalesce(arg_min(n, (created_at, event_id)), -1) AS resources
    FROM (SELECT platform, action, created_at, event_id, CASE WHEN platform <> 'azureml' THEN
        CASE resource_count % 4 WHEN 0 THEN CASE WHEN action = 'destroy' THEN 2 ELSE resource_count END
          WHEN 1 THEN resource_count WHEN 2 THEN CASE WHEN action = 'destroy' THEN resource_count ELSE 0 END
        END END AS n FROM infra) GROUP BY ALL""",
    "dataset_scan": with_(HOUSING)
    + """SELECT ave_occup, count(*) AS n, CAST(sum(population) AS BIGINT) AS population
    FROM housing GROUP BY ALL""",
    "lookup": with_(HOUSING)
    + """SELECT row_id, population FROM housing
    WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""",
    "sample_instance": with_(HOUSING)
    + f"SELECT {', '.join(FEATURES)} FROM housing ORDER BY row_id LIMIT 1",
    "normalized_columns": with_(HOUSING)
    + """SELECT ave_occup, count(*) AS n, CAST(sum(population) AS BIGINT) AS population
    FROM housing GROUP BY ALL""",
    "source_columns": with_(HOUSING)
    + "SELECT house_age, count(*) AS n, max(row_id) AS last_row FROM housing GROUP BY ALL",
    "dup_keys": """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
    "contract_violations": with_(HOUSING)
    + """SELECT * FROM (
      SELECT 4 AS rule_no, 'feature is null' AS rule, 'ave_rooms' AS column_name,
        count(*) FILTER (ave_rooms = 2) AS bad_rows FROM housing
      UNION ALL SELECT 4, 'feature is null', 'latitude', count(*) FILTER (latitude = 60)
        FROM housing
      UNION ALL SELECT 5, 'target is null', 'med_house_val', count(*) FILTER (ave_occup = 5)
        FROM housing
      UNION ALL SELECT 6, 'column missing', 'longitude', 1) WHERE bad_rows > 0""",
    "gold_schema": with_(HOUSING)
    + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, 'double' AS dtype, "
        f"count({c}) AS filled_rows FROM housing"
        for i, c in enumerate(FEATURES)
    ),
    "split_rows": with_(HOUSING) + f"SELECT row_id, {SPLIT} AS split FROM housing",
    "split_counts": with_(HOUSING)
    + f"SELECT {SPLIT} AS split, count(*) AS n FROM housing GROUP BY ALL",
    "exact_split": with_(HOUSING)
    + """, t AS (
      SELECT row_id, row_number() OVER (ORDER BY md5('42:test:' || row_id), row_id)
        <= ceil(0.2::DOUBLE * count(*) OVER ()) AS in_test FROM housing),
    v AS (
      SELECT row_id, row_number() OVER (ORDER BY md5('42:valid:' || row_id), row_id)
        <= ceil(0.2::DOUBLE * count(*) OVER ()) AS in_valid FROM t WHERE NOT in_test)
    SELECT row_id, CASE WHEN in_test THEN 'test' WHEN in_valid THEN 'valid' ELSE 'train' END
      AS split FROM t LEFT JOIN v USING (row_id)""",
    "fingerprint": with_(HOUSING)
    + f""", texts AS (SELECT CAST(row_id AS VARCHAR) AS a,
      CAST(CAST(population AS BIGINT) AS VARCHAR) AS b,
      CASE WHEN ave_rooms <> 2 THEN CAST(CAST(ave_rooms AS BIGINT) AS VARCHAR) END AS c,
      CAST(CAST(house_age AS BIGINT) AS VARCHAR) AS d,
      CASE WHEN ave_occup <> 5
        THEN CAST(CAST(round(med_house_val * 1000000) AS BIGINT) AS VARCHAR) END AS e
      FROM housing)
    SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({_MARKED}), 1, 12) AS BIGINT))
      AS VARCHAR) AS hash_sum FROM texts""",
    "export_fingerprint": "SELECT count(*) AS rows, 1 AS equal_content FROM orders",
    "classify_failures": f"SELECT doc_id, {classified('text')} AS failure_class FROM documents",
    "missing_predicates": f"""SELECT doc_id,
    CAST({any_word('text', MISSING_OBJECT_WORDS)} AS INTEGER) AS object_missing,
    CAST({any_word('text', PARENT_ABSENT_WORDS)} AS INTEGER) AS parent_gone,
    CAST({any_word('text', MISSING_SDK_WORDS)} AS INTEGER) AS sdk_missing FROM documents""",
    "exit_codes": with_(RUNS)
    + """SELECT run_id, CASE WHEN k % 5 IN (0, 4) THEN 'success' ELSE 'failure' END AS status,
    CASE k % 5 WHEN 1 THEN 'sdk' WHEN 2 THEN 'data' WHEN 3 THEN 'container' ELSE 'none' END
      AS failure_class,
    CASE WHEN k % 5 IN (0, 4) THEN '' ELSE left(repeat(stage || '/' || run_id || ' ', 200), 2000)
      END AS error_excerpt FROM runs""",
    "platform_units": with_(RUNS) + "SELECT run_id, tier, unification_unit FROM runs",
    "job_runs": with_(RUNS)
    + """SELECT CASE WHEN k % 5 > 2 THEN 'job-' || substr(run_id, 5) WHEN k = 4 THEN ''
      ELSE run_id END AS run_id, unification_unit,
    CASE WHEN k % 4 = 0 THEN 'success' ELSE 'failure' END AS status, attempt,
    CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'sdk' WHEN 2 THEN 'data' ELSE 'container' END
      AS failure_class,
    CASE WHEN k % 4 = 0 THEN '' ELSE 'the job ended' END AS error_excerpt, code_revision,
    CASE WHEN k % 5 > 2 THEN k || '.5' ELSE '' END AS rmse,
    CASE WHEN k % 5 > 2 THEN '31' ELSE '' END AS num_leaves,
    CASE WHEN k % 5 <= 2 AND k = 4 THEN 'run_id' ELSE '' END AS problem FROM runs""",
    "ledger_union": with_(RUNS)
    + """SELECT run_id, write_path, CASE WHEN write_path = 'direct' THEN attempt
    ELSE attempt + 10 END AS attempt FROM runs""",
    "ownership": with_(RUNS)
    + """SELECT run_id, stage, status,
    CASE WHEN stage = 'train' AND tier = 'A' THEN 'job' ELSE 'adapter' END AS origin
    FROM runs WHERE NOT (stage = 'train' AND status = 'success' AND tier = 'B')""",
    "insert_absent": with_(RUNS)
    + f"SELECT run_id, attempt FROM runs WHERE created_at >= TIMESTAMP '{CUTOFF}'",
    "load_counts": """WITH held AS (SELECT o_orderkey FROM orders WHERE o_totalprice < 250000),
    offered AS (SELECT DISTINCT l_orderkey FROM lineitem),
    n AS (SELECT (SELECT count(*) FROM lineitem) AS fetched,
      (SELECT count(*) FROM offered WHERE l_orderkey NOT IN (SELECT * FROM held)) AS inserted,
      (SELECT count(*) FROM held) AS held)
    SELECT fetched, inserted, held + inserted AS total, fetched - inserted AS skipped FROM n""",
    "cost_upsert": with_(AMOUNTS) + LATEST_COSTS + "SELECT * FROM latest",
    "cost_compacted": with_(AMOUNTS)
    + LATEST_COSTS
    + """SELECT *, (SELECT count(DISTINCT strftime(day, '%Y-%m')) FROM daily
      WHERE day >= DATE '2000-01-01')::INT AS months FROM latest""",
    "merge_params": with_(RUNS, PATCHES)
    + f""", reached AS (SELECT run_id, arg_max(note, patch_no) AS note, max(rank) AS rank
      FROM patches JOIN runs USING (run_id)
      WHERE patch_no = 2 OR created_at < TIMESTAMP '{CUTOFF}' GROUP BY run_id)
    SELECT run_id, coalesce(p.note, {js('params', 'note')}, '') AS note,
    coalesce(CAST(p.rank AS VARCHAR), '') AS rank,
    coalesce({js('params', 'num_leaves')}, '') AS num_leaves,
    coalesce({js('params', 'action')}, '') AS action
    FROM runs LEFT JOIN reached p USING (run_id)""",
    "handoff_merge": with_(RUNS, PATCHES)
    + f"""SELECT write_path, stage, coalesce(
      CASE WHEN write_path = 'direct' THEN p.note END, {js('params', 'note')}, '') AS note,
    count(*) AS n FROM runs LEFT JOIN last_patches p USING (run_id) GROUP BY ALL""",
    "merge_outcomes": with_(RUNS, PATCHES)
    + """SELECT run_id, CASE WHEN write_path IS NULL THEN 'absent'
      WHEN write_path = 'collected' THEN 'skipped_collected' ELSE 'merged' END AS outcome
    FROM last_patches LEFT JOIN runs USING (run_id)""",
    "next_attempt": with_(RUNS)
    + """, pairs AS (SELECT platform, stage FROM (VALUES ('vertex'), ('sagemaker'), ('azureml'),
      ('databricks'), ('snowflake')) p(platform), (VALUES ('train'), ('register'), ('deploy'),
      ('predict'), ('teardown')) s(stage))
    SELECT platform, stage, count(run_id) + 1 AS next_attempt
    FROM pairs FULL JOIN runs USING (platform, stage) GROUP BY ALL""",
    "collect_jsonl": with_(RUNS) + COLLECTED,
    "stream_collect": with_(RUNS) + COLLECTED,
    "stream_counters": with_(RUNS)
    + """SELECT platform, stage, count(*) AS runs,
    count(*) FILTER (status = 'failure') AS failures, count(*) + 1 AS next_attempt
    FROM runs GROUP BY ALL""",
    "collect_rejects": with_(RUNS)
    + """SELECT run_id, CASE k WHEN 3 THEN 'platform' ELSE 'json' END AS problem,
    (SELECT count(*) FROM runs WHERE k NOT IN (3, 7)) AS inserted,
    (SELECT count(*) FROM runs WHERE k IN (3, 7)) AS rejected FROM runs WHERE k IN (3, 7)""",
    "rejected_lines": with_(RUNS)
    + """SELECT run_id, CASE k WHEN 3 THEN 'platform' WHEN 4 THEN 'stage'
    WHEN 5 THEN 'failure_class' ELSE 'json' END AS problem FROM runs WHERE k IN (3, 4, 5, 7)""",
    "first_success": with_(RUNS, GOLDEN) + "SELECT platform, run_id, code_revision FROM firsts",
    "golden_snapshot": with_(RUNS, GOLDEN)
    + f"""SELECT platform, tier, code_revision, write_path,
    coalesce(CAST({js('metrics', 'rmse')} AS DOUBLE), -1) AS rmse,
    CAST({js('metrics', 'mae')} AS DOUBLE) AS mae, CAST({js('metrics', 'r2')} AS DOUBLE) AS r2
    FROM firsts""",
    "latest_artifact": with_(RUNS)
    + f"""SELECT platform, run_id, value FROM (SELECT platform, run_id,
      {js('params', 'model_artifact_uri')} AS value,
      row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, run_id DESC) AS rn
      FROM runs WHERE stage = 'train' AND status = 'success'
      AND list_contains(json_keys(params), 'model_artifact_uri')) WHERE rn = 1""",
    "latest_model_ref": with_(RUNS)
    + """SELECT platform, key, run_id, value FROM (SELECT platform, key, run_id,
      json_extract_string(params, '$.' || key) AS value,
      row_number() OVER (PARTITION BY platform ORDER BY key_no, created_at DESC, run_id DESC)
        AS rn
      FROM runs, (VALUES (0, 'model_resource_name'), (1, 'model_version'),
        (2, 'model_package_arn')) keys(key_no, key)
      WHERE stage = 'register' AND status = 'success'
      AND list_contains(json_keys(params), key)) WHERE rn = 1""",
    "latest_version": with_(RUNS)
    + f"""SELECT platform, max(CAST({js('params', 'model_version')} AS BIGINT)) AS latest_version
    FROM runs WHERE {js('params', 'model_version')} IS NOT NULL GROUP BY ALL""",
    "revision_compat": with_(RUNS, TREES)
    + """, points AS (SELECT * FROM (SELECT *,
      row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, run_id DESC) AS rn
      FROM runs WHERE stage = 'train' AND status = 'success') WHERE rn = 1),
    now AS (SELECT md5('rev1') || substr(md5('rev1'), 1, 8) AS rev)
    SELECT platform, run_id, CASE WHEN code_revision = rev THEN 'same_revision'
      WHEN tree_hash IS NULL THEN 'unknown'
      WHEN tree_hash = (SELECT tree_hash FROM trees, now WHERE code_revision = rev)
        THEN 'same_tree' ELSE 'different' END AS verdict
    FROM points LEFT JOIN trees USING (code_revision), now""",
    "coverage": with_(RUNS, ALL_PLATFORMS)
    + """, recorded AS (SELECT DISTINCT CASE WHEN platform = 'azureml' THEN 'other'
      ELSE platform END AS platform FROM runs)
    SELECT coalesce(d.platform, r.platform) AS platform,
      CASE WHEN r.platform IS NULL THEN 'missing' WHEN d.platform IS NULL THEN 'extra'
        ELSE 'both' END AS coverage
    FROM dim d FULL JOIN recorded r ON d.platform = r.platform""",
    "unknown_revisions": with_(RUNS, TREES)
    + """SELECT code_revision, count(*) AS runs FROM runs
    WHERE code_revision NOT IN (SELECT code_revision FROM trees)
      AND code_revision <> md5('rev6') || substr(md5('rev6'), 1, 8) GROUP BY ALL""",
    "training_trees": with_(RUNS, TREES)
    + """SELECT count(*) AS revisions, count(DISTINCT tree_hash) AS trees,
    CAST(count(DISTINCT tree_hash) <= 1 AS INTEGER) AS single_tree
    FROM (SELECT DISTINCT code_revision FROM runs) JOIN trees USING (code_revision)""",
    "parity_deviation": with_(RUNS, GOLDEN)
    + f"""SELECT platform, m AS rmse, round(abs(m - {BASELINE_RMSE}::DOUBLE), 9) AS deviation,
    CAST(abs(m - {BASELINE_RMSE}::DOUBLE) < 1e-6 AS INTEGER) AS within_tolerance
    FROM (SELECT platform, CAST({js('metrics', 'rmse')} AS DOUBLE) AS m FROM firsts)
    WHERE m IS NOT NULL""",
    "parity_spread": with_(RUNS, GOLDEN)
    + f"""SELECT count(*) AS platforms, round(max(m) - min(m), 9) AS spread,
    CAST(max(m) - min(m) < 1e-6 AS INTEGER) AS within_tolerance
    FROM (SELECT CAST({js('metrics', 'rmse')} AS DOUBLE) AS m FROM firsts)""",
    "domain_violations": with_(RUNS, BENT) + _DOMAIN_CASES,
    "bad_revisions": with_(RUNS, BENT)
    + """SELECT run_id, platform, code_revision FROM bent
    WHERE NOT regexp_full_match(code_revision, '[0-9a-f]{40}')""",
    "residual_findings": with_(INVENTORY)
    + "SELECT platform, kind, severity, item_count, coalesce(note, '') AS note FROM findings",
    "residual_items": with_(INVENTORY) + "SELECT * FROM items",
    "inventory_files": with_(INVENTORY) + "SELECT * FROM items",
    "item_pages": with_(INVENTORY)
    + """, sizes AS (SELECT platform, kind, CAST(ceil(count(*) / 20) AS BIGINT) AS pages
      FROM items GROUP BY ALL)
    SELECT platform, kind, CAST('0x' || substr(md5(item), 1, 8) AS BIGINT) % pages AS page,
      string_agg(shown, ',' ORDER BY shown) AS items
    FROM (SELECT *, item || CASE WHEN copies > 1 THEN ' (' || copies || ' times)' ELSE '' END
      AS shown FROM items) JOIN sizes USING (platform, kind) GROUP BY ALL""",
    "residual_report": with_(INVENTORY)
    + """, sizes AS (SELECT platform, kind, CAST(ceil(count(*) / 40) AS BIGINT) AS pages
      FROM items GROUP BY ALL),
    listed AS (SELECT platform, kind,
      CAST('0x' || substr(md5(item), 1, 8) AS BIGINT) % pages AS page,
      string_agg(shown, ', ' ORDER BY shown) AS items
      FROM (SELECT *, item || CASE WHEN copies > 1 THEN ' (' || copies || ' times)' ELSE '' END
        AS shown FROM items) JOIN sizes USING (platform, kind) GROUP BY ALL)
    SELECT platform, kind, coalesce(page, 0) AS page,
      '[' || severity || '] ' || platform || '/' || kind || ': '
      || CASE WHEN kind = 'fail_safe' THEN '7 days' ELSE coalesce(items, '-') END
      || CASE WHEN note IS NULL THEN '' ELSE '  # ' || note END AS line
    FROM findings LEFT JOIN listed USING (platform, kind)""",
    "infra_event_items": with_(INVENTORY)
    + """, hashed AS (SELECT *, md5('check-1:' || platform) AS h FROM items)
    SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
      || substr(h, 17, 4) || '-' || substr(h, 21) AS event_id, platform, kind,
      item || CASE WHEN copies > 1 THEN ' (' || copies || ' times)' ELSE '' END AS item
    FROM hashed""",
    "residual_summary": with_(INVENTORY)
    + """SELECT platform, count(severity) AS findings,
    count(*) FILTER (severity = 'FAIL') AS fails, count(*) FILTER (severity = 'ERROR') AS errors,
    count(*) FILTER (severity = 'WARN') AS warnings,
    CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'failure' ELSE 'success' END AS status,
    CAST(count(*) FILTER (severity IN ('FAIL', 'ERROR')) > 0 AS INTEGER) AS blocking
    FROM (VALUES ('vertex'), ('azureml'), ('snowflake')) dim(platform)
    LEFT JOIN findings USING (platform) GROUP BY platform""",
    "infra_event_rows": with_(INVENTORY, ALL_PLATFORMS)
    + """, ids AS (SELECT platform, md5('check-1:' || platform) AS h FROM dim)
    SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
      || substr(h, 17, 4) || '-' || substr(h, 21) AS event_id, platform, 'destroy' AS action,
    CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'failure' ELSE 'success' END AS status,
    CAST(count(severity) AS INTEGER) AS findings
    FROM ids LEFT JOIN findings USING (platform) GROUP BY platform, h""",
    "orphans": with_(INVENTORY)
    + """SELECT platform, kind, name FROM inventory o WHERE NOT EXISTS (
      SELECT 1 FROM inventory d WHERE d.p_size > 25 AND d.platform = o.platform
      AND d.kind = o.kind AND d.name = o.name)""",
    "nonempty_containers": with_(INVENTORY)
    + """SELECT platform, name FROM inventory WHERE kind IN ('gcs_object', 's3_object')
    AND (platform, name) IN (SELECT (platform, name) FROM objects)""",
    "parent_children": with_(INVENTORY)
    + f"""SELECT platform, kind, parent || '/' || name AS item FROM inventory
    WHERE contains(lower(parent), '{LAB}')""",
    "cost_nested": with_(AMOUNTS)
    + f"""SELECT 'sagemaker' AS platform, {_COST}, service, CAST(amount AS DOUBLE) AS amount_usd,
    'usd' AS unit FROM whole WHERE amount > 0""",
    "cost_usage": with_(AMOUNTS)
    + f"""SELECT 'databricks' AS platform, {_COST}, 'dbu:' || service AS service,
    CAST(quantity AS DOUBLE) AS amount_usd, 'dbu' AS unit FROM whole""",
    "cost_week": with_(AMOUNTS)
    + f"""SELECT 'databricks' AS platform, {_COST}, 'dbu:' || service AS service,
    CAST(quantity AS DOUBLE) AS amount_usd, 'dbu' AS unit FROM daily
    WHERE day >= DATE '2000-06-08' AND day < DATE '2000-06-15'""",
    "cost_credits": with_(AMOUNTS)
    + f"""SELECT 'snowflake' AS platform, {_COST}, 'warehouse:' || service AS service,
    CAST(quantity * 3.0015 AS DOUBLE) AS amount_usd, 'usd' AS unit FROM whole""",
    "cost_billing": with_(AMOUNTS)
    + f"""SELECT 'vertex' AS platform, {_COST}, service, CAST(amount AS DOUBLE) AS amount_usd,
    'usd' AS unit FROM whole""",
    "cost_flat": with_(AMOUNTS)
    + f"""SELECT 'azureml' AS platform, {_COST}, service, CAST(amount AS DOUBLE) AS amount_usd,
    'usd' AS unit FROM whole""",
    "cost_files": with_(AMOUNTS)
    + f"""SELECT 'databricks' AS platform, {_COST}, 'dbu:' || service AS service,
    CAST(quantity AS DOUBLE) AS amount_usd, 'dbu' AS unit FROM whole
    UNION ALL SELECT 'snowflake', {_COST}, 'warehouse:' || service,
    CAST(quantity * 3.0015 AS DOUBLE), 'usd' FROM whole""",
    "cost_all_files": with_(AMOUNTS)
    + f"""SELECT *, 0 AS problems FROM (
      SELECT 'sagemaker' AS platform, {_COST}, service, CAST(amount AS DOUBLE) AS amount_usd, 'usd' AS unit
        FROM whole WHERE amount > 0
      UNION ALL SELECT 'databricks', {_COST}, 'dbu:' || service, CAST(quantity AS DOUBLE), 'dbu' FROM whole
      UNION ALL SELECT 'snowflake', {_COST}, 'warehouse:' || service,
        CAST(quantity * 3.0015 AS DOUBLE), 'usd' FROM whole
      UNION ALL SELECT p, {_COST}, service, CAST(amount AS DOUBLE), 'usd'
        FROM whole, (VALUES ('vertex'), ('azureml')) t(p))""",
    "cost_problems": """SELECT platform, CASE platform WHEN 'vertex' THEN 1 ELSE 0 END AS unreadable
    FROM (VALUES ('vertex'), ('sagemaker'), ('azureml')) p(platform)
    WHERE EXISTS (SELECT 1 FROM lineitem)""",
    "cost_unavailable": with_(ALL_PLATFORMS)
    + """SELECT platform, CASE WHEN platform = 'azureml' THEN 'export could not be read'
    ELSE 'no cost export' END AS reason FROM dim
    WHERE platform <> 'databricks' OR NOT EXISTS (SELECT 1 FROM lineitem)""",
    "param_types": with_(RUNS)
    + """, p AS (SELECT params, unnest(json_keys(params)) AS key FROM runs),
    v AS (SELECT key, json_extract_string(params, '$.' || key) AS v FROM p)
    SELECT key, CASE WHEN NOT json_valid(v) THEN 'text' ELSE CASE json_type(v)
      WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
      WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text'
      ELSE 'nested' END END AS type, count(*) AS n, min(v) AS least, max(v) AS most
    FROM v GROUP BY ALL""",
    "param_merge": with_(RUNS)
    + f"""SELECT run_id, CAST(k AS VARCHAR) AS seed,
    coalesce({js('params', 'learning_rate')}, '0.05') AS learning_rate,
    coalesce({js('params', 'num_leaves')}, '63') AS num_leaves, '0.9' AS bagging_fraction,
    0 AS seed_leaks FROM runs""",
    "tracking_mirror": with_(RUNS, _MEMBERS)
    + f"""{_OWN}
    UNION ALL SELECT stage || '-' || run_id, {_STATE}, 'param', 'attempt', attempt, ''
      FROM runs WHERE platform = 'vertex'
    UNION ALL SELECT stage || '-' || run_id, {_STATE}, 'metric', 'duration_seconds',
      duration_seconds, '' FROM runs WHERE platform = 'vertex'
    UNION ALL SELECT run_name, {_STATE}, kind, key,
      CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(v AS DOUBLE) ELSE -1 END,
      CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '' WHEN t = 'NULL' THEN 'None'
        WHEN t = 'BOOLEAN' THEN upper(substr(v, 1, 1)) || substr(v, 2) ELSE v END FROM typed""",
    "artifact_listing": """SELECT uri,
    CASE WHEN p_size IN (10, 20) THEN '' ELSE 'models' END AS bucket,
    CASE WHEN p_size IN (10, 20) THEN '' ELSE p_partkey || '/' || p_type END AS key,
    CASE WHEN p_size IN (10, 20) THEN '' ELSE p_type END AS file_name,
    CASE p_size WHEN 10 THEN 'scheme' WHEN 20 THEN 'bucket' ELSE '' END AS problem
    FROM (SELECT *, CASE p_size WHEN 10 THEN 'other://models/' || p_partkey
      WHEN 20 THEN 'lab:///' || p_partkey
      ELSE 'lab://models/' || p_partkey || '/' || p_type END AS uri
      FROM part WHERE p_size <> 30)""",
    "transcript_counts": with_(K, INFRA)
    + """SELECT event_id, CASE resource_count % 4
      WHEN 0 THEN CASE WHEN action = 'destroy' THEN 2 ELSE resource_count END
      WHEN 1 THEN resource_count
      WHEN 2 THEN CASE WHEN action = 'destroy' THEN resource_count ELSE 0 END
      ELSE -1 END AS resources FROM infra""",
    "linear_eval_metrics": with_(HOUSING)
    + """SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
    round(1 - sum(e * e) / (var_pop(med_house_val) * count(*)), 6) AS r2
    FROM (SELECT med_house_val, med_house_val - (2.5 + 0.5 * med_inc) AS e FROM housing)""",
    "prediction_parity": with_(HOUSING)
    + """SELECT row_id, 2::BIGINT AS scored, CASE WHEN ave_rooms = 12 THEN 2::BIGINT
      ELSE 1::BIGINT END AS distinct_predictions,
    CASE WHEN ave_rooms = 12 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS spread,
    CASE WHEN ave_rooms = 12 THEN 0 ELSE 1 END AS within_tolerance FROM housing""",
    "payload_instances": with_(HOUSING)
    + f""", r AS (SELECT *, CAST(population AS BIGINT) || '-' || CAST(ave_rooms AS BIGINT) || '-'
      || row_id AS request_id, ave_bedrms = 31 AS o_has FROM housing)
    SELECT request_id, position, CASE WHEN o_has THEN 'missing features: latitude' ELSE '' END
      AS error, {_ONE_DOC} FROM r, (VALUES (0), (1)) p(position) WHERE ave_bedrms <> 1
    UNION ALL SELECT request_id, -1, 'no instances', {', '.join('-1.0' for _ in FEATURES)}
    FROM r WHERE ave_bedrms = 1""",
    "train_eval": with_(boosted(3, SMALL), stopped(3, 3))
    + f"""SELECT {measured()}, any_value(best)::INT AS best_iteration
    FROM predicted, best WHERE split = 'test' AND round = best""",
    "early_stop": with_(boosted(14, EAGER), stopped(3, 14))
    + """SELECT round, round(loss, 6) AS held_out_rmse, CAST(round = best AS INT) AS best,
    (SELECT count(*) FROM xs WHERE split = 'test') AS test_rows, 0 AS changed_by_saving
    FROM losses, best, last WHERE round <= last""",
    "training_job": with_(boosted(14, EAGER), bagged(3, 2).removeprefix(TREE_ROWS.strip() + ",\n"),
                          stopped(3, 14))
    + f"""SELECT 'job-1' AS run_id, {REVISION_1} AS code_revision, a.*, b.*, best::INT AS best_iteration
    FROM (SELECT {measured()} FROM predicted, best WHERE split = 'test' AND round = best) a,
      (SELECT {measured('baseline_')} FROM bagged WHERE split = 'test') b, best""",
    "baseline_eval": with_(bagged(3, 2))
    + f"SELECT {measured('baseline_')} FROM bagged WHERE split = 'test'",
    "bootstrap_weights": with_(HOUSING)
    + f"""SELECT tree, weight, count(*) AS rows, sum(row_id)::BIGINT AS keys FROM (
      SELECT row_id, tree::INT AS tree, (SELECT count(*) FROM (VALUES {POISSON_ENDS}) e(e) WHERE u >= e)::INT AS weight
      FROM (SELECT row_id, tree, CAST('0x' || substr(md5('42:bootstrap:' || tree // 4 || ':' || row_id),
        8 * (tree % 4) + 1, 8) AS BIGINT) AS u FROM housing, range(5) t(tree)))
    GROUP BY ALL""",
    "feature_importance": with_(boosted(3, SMALL))
    + f"""SELECT feature, round(coalesce(sum(gain) / {ONE}::DOUBLE / {ONE}::DOUBLE, 0), 4) AS gain, count(gain) AS split
    FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(FEATURES, 1))}) n(f, feature)
    LEFT JOIN splits USING (f) GROUP BY feature""",
    "score_payloads": with_(boosted(3, SMALL), stopped(3, 3))
    + """SELECT CAST(population AS BIGINT) || '-' || CAST(ave_rooms AS BIGINT) || '-' || row_id
      AS request_id, CASE WHEN ave_bedrms IN (1, 31) THEN 0 ELSE 2 END AS answers,
    CASE WHEN ave_bedrms IN (1, 31) THEN -1 ELSE round(p, 6) END AS first,
    CASE WHEN ave_bedrms = 1 THEN 'no instances' WHEN ave_bedrms = 31
      THEN 'missing features: latitude' ELSE '' END AS error
    FROM coarse JOIN (SELECT row_id, p FROM predicted, best WHERE round = best) USING (row_id)""",
}
