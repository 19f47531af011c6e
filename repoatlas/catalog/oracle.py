"""SQL that gives the same rows as each registered query, written for DuckDB.

The SQL is a second statement of the rules, not a rendering of the Spark plans: it chooses
the analyzer of a repo first and joins it to the files, ranks with plain windows, and
builds texts with ordered string aggregates.  It only shares the fixed values.
"""

from __future__ import annotations

from repoatlas import fixed_values as fv
from repoatlas.catalog import queries as rq
from repoatlas.catalog import views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def ends(expr: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {q(s)})" for s in suffixes) + ")"


def within(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"


def count(expr: str, regex: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(regex)}))"


def case(expr: str, table: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {q(other)} END"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(fv.WHITESPACE)})"


def fold(expr: str) -> str:
    return f"regexp_replace({expr}, {q(chr(10) + '{3,}')}, {q(chr(10) * 2)}, 'g')"


def fence_stripped(expr: str) -> str:
    """Text inside the outer fence, by splitting off the first line and the last fence."""
    first_line = f"CASE WHEN starts_with({expr}, '```markdown') THEN 11 ELSE 4 END"
    start = f"(strpos(substr({expr}, {first_line}), {q(chr(10))}) + {first_line} - 1)"
    end = f"(length({expr}) - strpos(reverse({expr}), '```') - 2)"
    has_line = f"strpos(substr({expr}, {first_line}), {q(chr(10))}) > 0"
    return (
        f"CASE WHEN starts_with({expr}, '```') AND contains(substr({expr}, 4), '```') "
        f"AND {has_line} AND {end} > {start} "
        f"THEN {strip(f'substr({expr}, {start} + 1, {end} - {start})')} ELSE {expr} END"
    )


def verdict(expr: str) -> str:
    last = f"upper({strip(f'list_last(string_split({strip(expr)}, {q(chr(10))}))')})"
    return (
        f"CASE WHEN contains({last}, 'YES') AND NOT contains({last}, 'NO') THEN true "
        f"WHEN contains({last}, 'NO') AND NOT contains({last}, 'YES') THEN false "
        f"ELSE contains(upper({expr}), 'YES') AND contains(upper({expr}), 'SHOULD BE REPLACED') END"
    )


def reasoning(expr: str) -> tuple[str, str]:
    found = f"regexp_extract_all({expr}, {q(fv.HTML_COMMENT)}, 1)"
    removed = f"regexp_replace({expr}, {q(fv.HTML_COMMENT)}, '', 'g')"
    return (
        f"CASE WHEN len({found}) > 0 THEN {strip(fold(removed))} ELSE {expr} END",
        strip(f"array_to_string({found}, {q(chr(10) * 2)})"),
    )


def watermark(expr: str) -> str:
    tail = f"\n\n{fv.WATERMARK_HEADING}\nGenerated on {rq.DATE} | Model: {rq.MODEL}"
    return f"{expr} || {q(tail)}"


# -- path rules -------------------------------------------------------------

LOWER = "lower(path)"
NAME = "list_last(string_split(path, '/'))"
DIR = "array_to_string(list_slice(string_split(path, '/'), 1, -2), '/')"
SUFFIX = r"regexp_extract(lower(path), '[^/]+(\.[^./]+)$', 1)"


def excluded(dirs=fv.EXCLUDED_DIRS) -> str:
    parts = "list_slice(string_split(path, '/'), 1, -2)"
    return f"list_has_any({parts}, [{', '.join(q(d) for d in dirs)}])"


SONAR = has(LOWER, fv.SONAR_MARKERS)
CONFIG = (
    f"({SONAR} OR ends_with({LOWER}, '.sh') OR {ends(LOWER, fv.CONFIG_EXTENSIONS)} "
    f"OR {ends(LOWER, fv.CONFIG_EXAMPLE_SUFFIXES)} OR {has(LOWER, fv.CONFIG_KEYWORDS)})"
)
CONFIG_LITE = f"({ends(LOWER, fv.CONFIG_LITE_EXTENSIONS)} OR {has(LOWER, fv.CONFIG_LITE_KEYWORDS)})"
SHELL = "ends_with(path, '.sh')"
ROOT_SHELL = f"({SHELL} AND NOT contains(path, '/') AND NOT contains(path, '\\'))"
EXAMPLE = f"({has(LOWER, fv.EXAMPLE_MARKERS)} AND {has(LOWER, fv.EXAMPLE_WORDS)})"
EXAMPLE_NAME = (
    f"({has(f'lower({NAME})', fv.EXAMPLE_MARKERS)} AND {has(f'lower({NAME})', fv.EXAMPLE_WORDS)})"
)
SPECIAL = has(LOWER, fv.SPECIAL_CONFIG_NAMES)
README = f"ends_with({LOWER}, 'readme.md')"
ORIGINAL = f"({within(LOWER, fv.README_NAMES)} OR ends_with({LOWER}, '/readme.md'))"
CATEGORY = (
    f"CASE WHEN {has(LOWER, fv.EXAMPLE_MARKERS)} THEN 'example' "
    f"WHEN {ends('path', ['.properties', '.yml', '.yaml'])} THEN 'config' ELSE 'other' END"
)
KIND = (
    f"CASE WHEN NOT {ROOT_SHELL} THEN NULL WHEN contains({LOWER}, 'start') THEN 'run' "
    f"WHEN contains({LOWER}, 'stop') THEN 'stop' WHEN contains({LOWER}, 'run') THEN 'run' END"
)


def key_file(analyzer: str) -> str:
    return within("path", fv.COMMON_KEY_FILES + fv.KEY_FILES[analyzer])


def analyzable(analyzer: str, readme: bool = True) -> str:
    out = f"({SHELL} OR {EXAMPLE} OR {ends('path', fv.EXTENSIONS[analyzer])}"
    return out + (f" OR {README})" if readme else ")")


def language(analyzer: str) -> str:
    return case(SUFFIX, fv.LANGUAGES[analyzer], fv.UNKNOWN_LANGUAGE)


def per_analyzer(make) -> str:
    return (
        f"CASE analyzer WHEN 'java' THEN {make('java')} WHEN 'python' THEN {make('python')} "
        f"ELSE {make('javascript')} END"
    )


def criteria(weights: dict[str, int]) -> str:
    return " + ".join(f"CASE WHEN contains({LOWER}, {q(w)}) THEN {n} ELSE 0 END" for w, n in weights.items())


def first_suffix(weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN ends_with({LOWER}, {q(s)}) THEN {n}" for s, n in weights.items())
    return f"CASE {whens} ELSE 0 END"


# -- score ------------------------------------------------------------------

def code_score(content: str = "body") -> str:
    chain = " ".join(f"WHEN {has(LOWER, words)} THEN {n}" for words, n in fv.PATH_CHAIN)
    settings = f"{ends(LOWER, ['.properties', '.yml'])} AND contains({LOWER}, 'application')"
    java = (
        f"{count(content, fv.STEREOTYPES)} * {fv.STEREOTYPE_WEIGHT} "
        f"+ CASE WHEN regexp_matches({content}, {q(fv.MAIN_SIGNATURE)}) THEN {fv.MAIN_WEIGHT} ELSE 0 END "
        f"+ {count(content, fv.MAPPINGS)} * {fv.MAPPING_WEIGHT}"
    )
    gradle = (
        f"CASE WHEN contains({content}, {q(fv.GRADLE_BOOT_PLUGIN)}) THEN {fv.GRADLE_BOOT_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN contains({content}, 'application') OR contains({content}, 'java') "
        f"THEN {fv.GRADLE_APPLICATION_WEIGHT} ELSE 0 END "
        f"+ {count(content, fv.GRADLE_TASK)} * {fv.GRADLE_TASK_WEIGHT}"
    )
    return (
        f"CASE WHEN contains({content}, {q(fv.BOOT_ANNOTATION)}) THEN {fv.BOOT_WEIGHT} ELSE 0 END "
        f"+ CASE {chain} ELSE 0 END "
        f"+ CASE WHEN contains({LOWER}, 'application') AND {ends(LOWER, fv.EXAMPLE_MARKERS)} "
        f"THEN {fv.APPLICATION_EXAMPLE_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN contains({LOWER}, 'gradle') THEN {fv.GRADLE_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN {settings} THEN {fv.APPLICATION_CONFIG_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN {settings} AND {has(LOWER, ['local', 'dev'])} THEN {fv.LOCAL_CONFIG_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN ends_with({LOWER}, '.java') THEN {java} "
        f"WHEN ends_with({LOWER}, '.gradle') THEN {gradle} ELSE 0 END"
    )


def base_score() -> str:
    return (
        f"CASE WHEN is_entry THEN {fv.ENTRY_POINT_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN is_key THEN {fv.KEY_FILE_WEIGHT} ELSE 0 END"
    )


def java_extra() -> str:
    return (
        f"CASE WHEN ends_with({LOWER}, '.sh') THEN {fv.SHELL_WEIGHT} ELSE 0 END "
        f"+ CASE WHEN contains({LOWER}, 'dockerfile') THEN {fv.DOCKERFILE_WEIGHT} "
        f"WHEN contains({LOWER}, 'docker-compose.yml') THEN {fv.COMPOSE_WEIGHT} ELSE 0 END"
    )


# -- tables -----------------------------------------------------------------

def _files_id() -> str:
    paths = ", ".join(q(p) for variants, _ in views.TEMPLATES for p in variants)
    prefixes = ", ".join(q(prefix) for _, prefix in views.TEMPLATES)
    return (
        "SELECT doc_id, source || '_' || CAST(doc_id // 320 AS VARCHAR) AS repo, "
        f"([{paths}])[(doc_id // 20) % 16 * 3 + (doc_id % 20) % 3 + 1] AS path, "
        f"([{prefixes}])[(doc_id // 20) % 16 + 1] || text AS content FROM documents"
    )


def _markers(analyzer: str) -> str:
    tests = [f"path = {q(m)} OR starts_with(path, {q(m + '/')})" for m in fv.MARKERS[analyzer]]
    return "bool_or(" + " OR ".join(tests) + ")"


def gathered_with(analyzers: str) -> dict[str, str]:
    """Tables of classified files, for a table ``repo, analyzer``."""
    entry = (
        "CASE WHEN lang = 'Java' THEN "
        f"contains(body, {q(fv.BOOT_ANNOTATION)}) OR regexp_matches(body, {q(fv.MAIN_METHOD)}) "
        f"ELSE (lang = 'Gradle' OR contains({LOWER}, 'gradle')) AND "
        f"(regexp_matches(body, {q(fv.GRADLE_APPLY_APPLICATION)}) "
        f"OR regexp_matches(body, {q(fv.GRADLE_PLUGINS_APPLICATION)})) END"
    )
    return {
        "listed": (
            f"SELECT repo, analyzer, path, size, content, "
            f"CASE WHEN size <= {fv.MAX_FILE_BYTES} THEN content ELSE '' END AS body, "
            f"{per_analyzer(language)} AS lang, {per_analyzer(key_file)} AS is_key, "
            f"size <= {fv.MAX_FILE_BYTES} AND path <> {q(fv.CI_FILE)} AND NOT {SONAR} "
            f"AND NOT {excluded()} AS is_walked, {EXAMPLE_NAME} AS is_example "
            f"FROM files JOIN {analyzers} USING (repo)"
        ),
        "flagged": (
            f"SELECT *, is_walked AND (is_key OR {per_analyzer(analyzable)}) AS is_gathered, "
            f"CASE WHEN is_key THEN '0' ELSE '1' END || path AS ord FROM listed"
        ),
        "survey": (
            f"SELECT *, is_gathered AND analyzer = 'java' AND NOT is_key AND ({entry}) AS is_entry, "
            f"is_gathered AND ({CONFIG} OR (NOT is_key AND ({SHELL} OR {EXAMPLE})) OR {SPECIAL}) "
            "AS is_config FROM flagged"
        ),
        "scored": (
            f"SELECT *, CASE WHEN analyzer = 'java' THEN {base_score()} + {code_score()} + {java_extra()} "
            f"ELSE {base_score()} END AS score FROM survey WHERE is_gathered"
        ),
        "ranked": (
            "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, ord) AS rn FROM scored"
        ),
    }


def _dependency(kind: int, regex: str) -> str:
    part = [f"regexp_extract(m, {q(regex)}, {g})" for g in (1, 2, 3, 4)]
    text = (
        f"{part[0]} || '(group: ''' || {part[1]} || ''', name: ''' || {part[2]} || ''', version: ''' || {part[3]} || ''')'"
        if kind == 1
        else f"{part[0]} || ' ''' || {part[1]} || ':' || {part[2]} || ':' || {part[3]} || ''''"
    )
    return (
        f"SELECT repo, path, block, {kind} AS kind, n, {part[0]} AS config, {part[1]} AS group_id, "
        f"{part[2]} AS artifact, {part[3]} AS version, {text} AS text FROM ("
        f"SELECT repo, path, block, unnest(ms) AS m, generate_subscripts(ms, 1) AS n FROM ("
        f"SELECT *, regexp_extract_all(body, {q(regex)}) AS ms FROM gradle_blocks))"
    )


MAVEN = [strip(f"regexp_extract(m, {q(fv.MAVEN_DEPENDENCY)}, {g})") for g in (1, 2, 3)]


def _tables() -> dict[str, str]:
    out = {
        "files_id": _files_id(),
        "files": "SELECT repo, path, CAST(strlen(content) AS BIGINT) AS size, content FROM files_id",
        "analyzers": (
            f"SELECT repo, CASE WHEN {_markers('java')} THEN 'java' WHEN {_markers('python')} THEN 'python' "
            f"WHEN {_markers('javascript')} THEN 'javascript' ELSE 'java' END AS analyzer "
            "FROM files GROUP BY repo"
        ),
        **gathered_with("analyzers"),
        "step_outputs": (
            "SELECT CAST(conv_id AS VARCHAR) AS repo, CAST(turn + 1 AS INTEGER) AS step, "
            "text AS output, role FROM conversations"
        ),
        "completions": "SELECT repo, step, output FROM step_outputs WHERE (CAST(repo AS BIGINT) + step) % 3 <> 0",
        "fenced": (
            "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '```markdown\n' || text || '\n```\nbye' "
            "WHEN 1 THEN '```\n' || text || '\n```' ELSE text END AS text FROM conversations"
        ),
        "corpus_outputs": (
            "SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) || '_' || CAST(conv_id // 20 AS VARCHAR) AS repo, "
            "CAST(turn + 1 AS INTEGER) AS step, text AS output FROM fenced"
        ),
        "verdicts": (
            "SELECT repo, CASE WHEN quality = 1 THEN 'Specific enough.\nNO' ELSE 'Mostly template text.\nYES' END AS output "
            "FROM files_id JOIN labels USING (doc_id) WHERE path = 'README.md'"
        ),
        "page_outputs": (
            "SELECT CAST(page_id AS VARCHAR) AS repo, CAST(page_id % 2 + 3 AS INTEGER) AS step, html AS output FROM pages"
        ),
        "api": (
            "SELECT 'src' || CAST(page_id % 20 AS VARCHAR) || '_' || CAST(page_id // 20 % 4 AS VARCHAR) AS repo, page_id, "
            "CASE WHEN page_id % 4 = 3 THEN 'Other' WHEN page_id % 3 = 0 THEN 'Page' ELSE 'Api' END AS type, "
            "CASE page_id % 4 WHEN 0 THEN '- GET ' || url WHEN 1 THEN '- ' || url ELSE '- Repository: ' || url END AS line, url FROM pages"
        ),
        "gradle_blocks": (
            "SELECT repo, path, unnest(bs) AS body, generate_subscripts(bs, 1) AS block FROM ("
            f"SELECT repo, path, regexp_extract_all(content, {q(fv.GRADLE_DEPENDENCY_BLOCK)}, 1) AS bs "
            "FROM files WHERE ends_with(path, '.gradle'))"
        ),
        "gradle_deps": " UNION ALL ".join(
            [_dependency(0, fv.GRADLE_DEPENDENCY), _dependency(1, fv.GRADLE_DEPENDENCY_MAP)]
        ),
        "maven_deps": (
            f"SELECT repo, path, n, '' AS config, {MAVEN[0]} AS group_id, {MAVEN[1]} AS artifact, {MAVEN[2]} AS version, "
            f"{MAVEN[0]} || ':' || {MAVEN[1]} || ':' || {MAVEN[2]} AS text FROM ("
            "SELECT repo, path, unnest(ms) AS m, generate_subscripts(ms, 1) AS n FROM ("
            f"SELECT repo, path, regexp_extract_all(content, {q(fv.MAVEN_DEPENDENCY)}) AS ms FROM files WHERE ends_with(path, 'pom.xml')))"
        ),
        "build_scores": (
            f"SELECT repo, path, size, CASE WHEN {key_file('java')} THEN {fv.KEY_FILE_WEIGHT} "
            f"WHEN contains({LOWER}, 'gradle') AND (regexp_matches(content, {q(fv.GRADLE_APPLY_APPLICATION)}) "
            f"OR regexp_matches(content, {q(fv.GRADLE_PLUGINS_APPLICATION)})) THEN {fv.ENTRY_POINT_WEIGHT} ELSE 0 END "
            f"+ {code_score('content')} + {java_extra()} AS score FROM files "
            "WHERE ends_with(path, '.gradle') OR ends_with(path, 'pom.xml')"
        ),
        "deps": (
            "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, "
            f"CASE WHEN {key_file('java')} THEN 0 ELSE 1 END, path, block, kind, n) AS rn, "
            "count(*) OVER (PARTITION BY repo) AS total FROM ("
            "SELECT repo, path, block, kind, n, text, size, score FROM gradle_deps JOIN build_scores USING (repo, path) UNION ALL "
            "SELECT repo, path, 0, 0, n, text, size, score FROM maven_deps JOIN build_scores USING (repo, path)) "
            f"WHERE size <= {fv.MAX_FILE_BYTES} AND NOT {excluded()}"
        ),
        "stats": (
            "SELECT repo, lang, count(*) AS n, min(ord) AS first FROM survey WHERE is_gathered GROUP BY repo, lang"
        ),
        "main_language": (
            "SELECT repo, CASE WHEN bool_or(lang = 'Java') THEN 'Java' ELSE arg_max(lang, pos) END AS primary_language FROM ("
            "SELECT *, -row_number() OVER (PARTITION BY repo ORDER BY n DESC, first) AS pos FROM stats) GROUP BY repo"
        ),
        "configs": (
            "SELECT repo, path, is_gathered, body, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN is_config THEN 0 ELSE 1 END, "
            "CASE WHEN is_config THEN ord ELSE path END) AS rn FROM survey WHERE is_config OR is_example"
        ),
        "tools": (
            "SELECT repo, tool, min(seen) AS seen FROM ("
            + " UNION ALL ".join(
                f"SELECT repo, {q(tool)} AS tool, {{'fall': -score, 'ord': ord, 'digit': {digit}}} AS seen FROM scored "
                f"WHERE analyzer = 'java' AND {test}"
                for tool, digit, test in [
                    ("docker", 0, has("path", fv.TOOL_NAMES["docker"])),
                    ("spring-boot", 1, has("path", fv.TOOL_NAMES["spring-boot"])),
                    ("lombok", 2, has("path", fv.TOOL_NAMES["lombok"])),
                    ("spring-boot", 3, f"ends_with(path, '.java') AND contains(body, {q(fv.BOOT_ANNOTATION)})"),
                    ("spring-boot", 3, f"ends_with(path, '.gradle') AND contains(body, {q(fv.GRADLE_BOOT_PLUGIN)})"),
                    ("lombok", 4, "ends_with(path, '.gradle') AND contains(body, 'lombok')"),
                ]
            )
            + ") GROUP BY repo, tool"
        ),
        "scripts": (
            f"SELECT repo, {KIND} AS kind, './' || path AS command, {{'fall': -score, 'ord': ord}} AS place FROM scored "
            f"WHERE analyzer = 'java' AND {KIND} IS NOT NULL"
        ),
        "commands": (
            "SELECT repo, kind, command, row_number() OVER (PARTITION BY repo ORDER BY first, place) AS pos FROM ("
            "SELECT *, min(place) OVER (PARTITION BY repo, kind) AS first FROM scripts) UNION ALL "
            "SELECT repo, 'gradle', './gradlew build', 1 FROM analyzers WHERE repo NOT IN (SELECT repo FROM scripts) UNION ALL "
            "SELECT repo, 'run', './gradlew run', 2 FROM survey WHERE is_gathered AND path = 'build.gradle' "
            "AND contains(body, 'mainClass') AND repo NOT IN (SELECT repo FROM scripts)"
        ),
        "counts": (
            "SELECT repo, analyzer, count_if(is_gathered) AS total_files, "
            f"bool_or(is_gathered AND lang = 'Java' AND contains(body, {q(fv.BOOT_ANNOTATION)})) AS has_spring_boot, "
            "count_if(is_entry) AS n_entry_points, count_if(is_config OR is_example) AS n_config_files, "
            f"count_if(is_gathered AND is_key) AS n_key_files, count_if(is_gathered AND {SHELL}) AS n_shell_scripts, "
            f"count_if(is_gathered AND {ROOT_SHELL}) AS n_root_shell_scripts, count_if(is_gathered AND {README}) AS n_readmes, "
            "count_if(is_example) AS n_example_configs FROM survey GROUP BY repo, analyzer"
        ),
        "builds": (
            "SELECT repo, CASE WHEN bool_or(java AND ends_with(path, '.gradle')) THEN 'gradle' ELSE 'unknown' END AS type, "
            "bool_or(analyzer = 'java' AND (path = 'gradlew' OR starts_with(path, 'gradlew/'))) AS has_wrapper, "
            "count_if(java AND ends_with(path, '.gradle')) AS n_gradle_files, "
            f"count_if(java AND {ROOT_SHELL}) AS n_root_scripts, count_if(java AND coalesce({KIND}, '') = 'run') AS n_run, "
            f"count_if(java AND coalesce({KIND}, '') = 'stop') AS n_stop "
            "FROM (SELECT *, is_gathered AND analyzer = 'java' AS java FROM survey) GROUP BY repo"
        ),
        "profiles": (
            "SELECT c.*, coalesce(primary_language, 'Unknown') AS primary_language, b.* EXCLUDE (repo), "
            "coalesce(k.keys, '') AS key_project_files, coalesce(k.other, 'None found') AS other_keys, "
            "coalesce(k.config, 'None found') AS config_keys, coalesce(k.example, 'None found') AS example_keys, "
            "coalesce(t.tools, '') AS custom_tools, coalesce(t.shown, 'None detected') AS tools_shown, "
            "coalesce(l.langs, '') AS language_stats, coalesce(l.shown, '') AS languages_shown, "
            "coalesce(f.top, '') AS top_files "
            "FROM counts c LEFT JOIN main_language USING (repo) LEFT JOIN builds b USING (repo) "
            "LEFT JOIN (SELECT repo, string_agg(path, '|' ORDER BY path) AS keys, "
            + ", ".join(
                f"string_agg('- ' || path, '\n' ORDER BY path) FILTER (WHERE {CATEGORY} = '{c}') AS {c}"
                for c in ("other", "config", "example")
            )
            + " FROM survey WHERE is_gathered AND is_key GROUP BY repo) k USING (repo) "
            "LEFT JOIN (SELECT repo, string_agg(tool, '|' ORDER BY seen) AS tools, string_agg(tool, ', ' ORDER BY seen) AS shown "
            "FROM tools GROUP BY repo) t USING (repo) "
            "LEFT JOIN (SELECT repo, string_agg(lang || ':' || n, '|' ORDER BY n DESC, first) AS langs, "
            "string_agg('- ' || lang || ': ' || n || ' files', '\n' ORDER BY n DESC, first) AS shown FROM stats GROUP BY repo) l USING (repo) "
            f"LEFT JOIN (SELECT repo, string_agg(path || ':' || lang || ':' || score, '|' ORDER BY rn) AS top FROM ranked "
            f"WHERE rn <= {fv.TOP_FILES_IN_PROFILE} GROUP BY repo) f USING (repo)"
        ),
        "lines": (
            "SELECT p.repo, "
            "(SELECT string_agg('- ' || path, '\n' ORDER BY ord) FROM survey s WHERE s.repo = p.repo AND is_entry) AS entries, "
            f"(SELECT string_agg('- ' || path, '\n' ORDER BY ord) FROM survey s WHERE s.repo = p.repo AND is_gathered AND {SHELL}) AS shells, "
            f"(SELECT string_agg('- ' || path, '\n' ORDER BY ord) FROM survey s WHERE s.repo = p.repo AND is_gathered AND {ROOT_SHELL}) AS roots, "
            "(SELECT string_agg('- ' || kind || ': `' || command || '`', '\n' ORDER BY pos) FROM commands c WHERE c.repo = p.repo "
            "AND c.repo IN (SELECT repo FROM scripts)) AS cmds, "
            "(SELECT string_agg('- ' || kind || ': `' || command || '`\n', '' ORDER BY pos) FROM commands c WHERE c.repo = p.repo) AS all_cmds, "
            f"(SELECT string_agg('- ' || text, '\n' ORDER BY rn) FILTER (WHERE rn <= {fv.DEPENDENCIES_SHOWN}) || "
            f"CASE WHEN max(total) > {fv.DEPENDENCIES_SHOWN} THEN '\n- ... and ' || (max(total) - {fv.DEPENDENCIES_SHOWN}) || ' more' ELSE '' END "
            "FROM deps d WHERE d.repo = p.repo) AS depends, "
            "(SELECT string_agg('\n\n**' || type || '**:' || rows, '' ORDER BY first) FROM ("
            "SELECT repo, type, min(page_id) AS first, string_agg('\n' || line, '' ORDER BY page_id) AS rows FROM api GROUP BY repo, type) a "
            "WHERE a.repo = p.repo) AS apis FROM profiles p"
        ),
        "few": _few(),
        "reports": _reports(),
        "readmes": (
            f"SELECT repo, content FROM ranked WHERE {ORIGINAL} "
            "QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, ord) = 1"
        ),
        "pairs": (
            f"SELECT a.repo, CASE WHEN regexp_matches(r.content, '\\S') THEN r.content ELSE {q(fv.NO_ORIGINAL_README)} END AS original_readme, "
            f"coalesce({fence_stripped('o.output')}, '') AS generated_readme FROM analyzers a LEFT JOIN readmes r USING (repo) "
            "LEFT JOIN (SELECT repo, output FROM corpus_outputs WHERE step = 3) o USING (repo)"
        ),
        "made_pairs": (
            "SELECT repo, CASE WHEN doc_id % 7 = 0 THEN '  # tiny\n' ELSE content END AS original_readme, "
            "'# ' || repo AS generated_readme FROM files_id WHERE path = 'README.md'"
        ),
        "picked_1": f"SELECT * FROM ranked WHERE is_entry OR is_key OR rn <= {fv.TOP_FILES_STEP_1}",
        "picked_3": f"SELECT * FROM ranked WHERE is_entry OR is_key OR rn <= {fv.TOP_FILES_STEP_3}",
        "optimized": (
            f"SELECT p.repo, original_readme, generated_readme, {_low('p')} AS is_low_quality, "
            f"CASE WHEN {_minimal('p')} THEN {q(fv.MINIMAL_README_REASON)} ELSE coalesce(v.output, {q(fv.EVALUATION_ERROR)}) END AS reason "
            "FROM pairs p LEFT JOIN verdicts v USING (repo)"
        ),
    }
    return out


def _minimal(alias: str) -> str:
    body = strip(f"{alias}.original_readme")
    return f"({body} = {q(fv.NO_ORIGINAL_README)} OR length({body}) < {fv.MIN_README_CHARS})"


def _low(alias: str) -> str:
    return f"CASE WHEN {_minimal(alias)} THEN true ELSE coalesce({verdict('v.output')}, false) END"


def _reports() -> str:
    """Text of the report with and without the API part."""
    system = "(upper(type[1]) || type[2:] || CASE WHEN has_wrapper THEN ' with wrapper' ELSE '' END)"
    head = (
        "'# Repository Analysis for: ' || repo || '\nPrimary Language: ' || primary_language || "
        "'\nTotal Files: ' || total_files || '\n\n## Overview\n'"
    )
    indent = "\n    "

    def java(apis: str) -> str:
        return (
            f"rtrim({q('## Java/Gradle Repository Analysis' + chr(10) + indent + 'This Java repository uses ')} || {system} || ' build system.' || "
            f"CASE WHEN has_spring_boot THEN {q(chr(10) + fv.SPRING_BOOT_SENTENCE)} ELSE '' END || "
            f"{q(indent + '### Key Components:' + indent)} || other_keys || "
            f"{q(chr(10) + indent + '### Entry Points:' + indent)} || coalesce(entries, 'None found') || "
            f"{q(chr(10) + indent + '### Configuration Files:' + indent)} || config_keys || "
            f"{q(chr(10) + indent + '### Example Configuration Files:' + indent)} || example_keys || "
            f"{q(chr(10) + indent + '### File Distribution:' + indent)} || languages_shown || "
            f"{q(chr(10) + indent + '### Build System:' + indent + '- Type: ')} || {system} || {q(indent + '- Commands:')} || "
            f"coalesce('\n\nBuild System Commands:\n' || cmds || '\n', '') || "
            f"{q(chr(10) + indent + '### Tools and Technologies:' + indent)} || tools_shown || {q(indent)} || "
            f"coalesce('\n\nRoot Shell Scripts:\n' || roots || '\n', '') || {q(indent)} || "
            f"coalesce('\n\n### API Endpoints:' || {apis} || '\n', ''), ' \n')"
        )

    def text(apis: str) -> str:
        return (
            f"{head} || CASE analyzer WHEN 'java' THEN {java(apis)} WHEN 'python' THEN {q(fv.PYTHON_ANALYSIS)} "
            f"ELSE {q(fv.JAVASCRIPT_ANALYSIS)} END || '\n\n## File Breakdown' || "
            "CASE WHEN languages_shown <> '' THEN '\n' || languages_shown ELSE '' END || "
            "coalesce('\n\n## Entry Points\n' || entries, '') || "
            "CASE WHEN analyzer = 'java' THEN coalesce('\n\n## Build Commands\n' || cmds, '') || "
            "coalesce('\n\n## Dependencies\n' || depends, '') ELSE coalesce('\n\n## Root Shell Scripts\n' || roots, '') END"
        )

    quick = (
        f"{head} || CASE analyzer WHEN 'java' THEN {java('apis')} WHEN 'python' THEN {q(fv.PYTHON_ANALYSIS)} "
        f"ELSE {q(fv.JAVASCRIPT_ANALYSIS)} END || '\n\n## File Breakdown' || "
        "CASE WHEN languages_shown <> '' THEN '\n' || languages_shown ELSE '' END || "
        "CASE WHEN analyzer = 'java' THEN '\n\n## Quick Start' || coalesce('\n### Entry Points\n' || few_entries, '') || "
        "coalesce('\n\n### Build Commands\n' || few_cmds, '') || coalesce('\n\n## Dependencies\n' || few_deps, '') || "
        "coalesce('\n\n## API Endpoints\n' || few_apis, '') "
        "ELSE coalesce('\n\n## Entry Points\n' || entries, '') || coalesce('\n\n## Root Shell Scripts\n' || roots, '') END"
    )
    return (
        f"SELECT repo, {text('apis')} AS with_api, {text('CAST(NULL AS VARCHAR)')} AS text, {quick} AS quick "
        "FROM profiles JOIN lines USING (repo) LEFT JOIN few USING (repo)"
    )


def _few() -> str:
    """Short lists of the quick start form."""

    def capped(source: str, n: int, what: str) -> str:
        return (
            f"(SELECT string_agg('- ' || line, '\n' ORDER BY rn) FILTER (WHERE rn <= {n}) || "
            f"CASE WHEN count(*) > {n} THEN '\n- ... and ' || (count(*) - {n}) || ' more {what}' ELSE '' END FROM ({source}) s WHERE s.repo = p.repo)"
        )

    entries = "SELECT repo, path AS line, row_number() OVER (PARTITION BY repo ORDER BY ord) AS rn FROM survey WHERE is_entry"
    apis = (
        "SELECT repo, CASE page_id % 4 WHEN 0 THEN 'GET ' || url WHEN 1 THEN 'Controller: ' || url ELSE 'Repository: ' || url END AS line, "
        "row_number() OVER (PARTITION BY repo ORDER BY page_id) AS rn FROM api"
    )
    commands = (
        "(SELECT string_agg(shown, '\n' ORDER BY first) FROM (SELECT repo, kind, min(pos) AS first, "
        f"string_agg('- ' || kind || ': `' || command || '`', '\n' ORDER BY pos) FILTER (WHERE k <= {fv.QUICK_START_COMMANDS}) || "
        f"CASE WHEN count(*) > {fv.QUICK_START_COMMANDS} THEN '\n  ... and ' || (count(*) - {fv.QUICK_START_COMMANDS}) || ' more ' || kind || ' commands' ELSE '' END AS shown "
        "FROM (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY pos) AS k FROM commands WHERE repo IN (SELECT repo FROM scripts)) "
        "GROUP BY repo, kind) c WHERE c.repo = p.repo)"
    )
    return (
        f"SELECT p.repo, {capped(entries, fv.QUICK_START_ENTRY_POINTS, 'entry points')} AS few_entries, {commands} AS few_cmds, "
        f"{capped('SELECT repo, text AS line, rn FROM deps', fv.QUICK_START_DEPENDENCIES, 'dependencies')} AS few_deps, "
        f"{capped(apis, fv.QUICK_START_API, 'endpoints/controllers')} AS few_apis FROM profiles p"
    )


TABLES = _tables()


def sql(body: str, **extra: str) -> str:
    tables = {**TABLES, **extra}
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in tables.items()) + "\n" + body


def flags(**columns: str) -> str:
    made = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return sql(f"SELECT repo, path, {made} FROM files")


def java_sql(body: str) -> str:
    return sql(body, **gathered_with("(SELECT DISTINCT repo, 'java' AS analyzer FROM files)"))


def _four_languages() -> str:
    """``repo, analyzer`` where the language of `queries.SCRIPTS` is looked for first."""
    return (
        f"SELECT repo, CASE WHEN bool_or(path = 'app.py' OR starts_with(path, 'app.py/') OR path = 'ops' OR starts_with(path, 'ops/')) "
        f"THEN 'scripts' WHEN {_markers('java')} THEN 'java' WHEN {_markers('python')} THEN 'python' "
        f"WHEN {_markers('javascript')} THEN 'javascript' ELSE 'java' END AS analyzer FROM files GROUP BY repo"
    )


def plugin_sql(body: str) -> str:
    """SQL over ``classified``: files of four languages, those of the new one by their own rules."""
    key = within("path", [*fv.COMMON_KEY_FILES, "app.py"])
    lang = case(SUFFIX, {".sh": "Shell", ".ts": "TypeScript", ".md": "Markdown", ".yml": "YAML"}, "Unknown")
    columns = "repo, analyzer, path, size, lang, is_key, is_entry, is_config, ord, body, score"
    own = (
        f"SELECT *, CASE WHEN is_key THEN '0' ELSE '1' END || path AS ord, "
        "CASE WHEN is_entry THEN 100 ELSE 0 END + CASE WHEN is_key THEN 80 ELSE 0 END "
        f"+ 2 * {count('body', 'the ')} + CASE WHEN contains(path, 'scripts') THEN 40 ELSE 0 END AS score FROM ("
        "SELECT *, NOT is_key AND ((lang = 'Shell' AND starts_with(body, '#!')) OR starts_with(path, 'scripts/')) AS is_entry, "
        f"{CONFIG} OR (NOT is_key AND ({SHELL} OR {EXAMPLE})) OR {SPECIAL} AS is_config FROM ("
        f"SELECT repo, analyzer, path, size, content AS body, {lang} AS lang, {key} AS is_key "
        f"FROM files JOIN ({_four_languages()}) USING (repo) WHERE analyzer = 'scripts' AND size <= {fv.MAX_FILE_BYTES} "
        f"AND path <> {q(fv.CI_FILE)} AND NOT {SONAR} AND NOT {excluded()} "
        f"AND ({key} OR {SHELL} OR {EXAMPLE} OR {README} OR {ends('path', ['.sh', '.ts', '.md'])})))"
    )
    others = gathered_with(f"(SELECT * FROM ({_four_languages()}) WHERE analyzer <> 'scripts')")
    return sql(
        body, **others, classified=f"SELECT {columns} FROM ({own}) UNION ALL SELECT {columns} FROM scored"
    )


DIGEST = "md5(coalesce(content, ''))"


#: The files as they are stored by source, and their places in a tar of each source.
STORED = (
    "SELECT doc_id, coalesce(source, 'none') AS source, repo || '/' || path AS inside, content, "
    "CAST(strlen(content) AS BIGINT) AS size FROM files_id JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"
)
HALVES = (
    "SELECT *, sum(room) OVER (PARTITION BY source) // 2 AS half, "
    "sum(room) OVER (PARTITION BY source ORDER BY inside) - room + 512 + size AS until FROM ("
    f"SELECT *, 512 + (size + 511) // 512 * 512 AS room FROM ({STORED}))"
)


def block(path: str = "path", content: str = "content") -> str:
    return f"'### ' || {path} || '\n```\n' || {content} || '\n```\n\n'"


def fill(step: int, values: dict[str, str]) -> str:
    """Template with its slots replaced in their order."""
    out = q(fv.STEP_TEMPLATES[step])
    for slot in fv.STEP_SLOTS[step]:
        out = f"replace({out}, {q('${' + slot + '}')}, {values[slot]})"
    return fold(out)


def _prompts() -> str:
    shared = {
        "name": "p.repo", "language": "primary_language",
        "is_spring_boot": f"CASE WHEN has_spring_boot THEN {q(fv.SPRING_BOOT_SENTENCE)} ELSE '' END",
        "build_system": "'Build System: ' || type",
    }

    def blocks(table: str, condition: str = "true", order: str = "ord") -> str:
        return (
            f"coalesce((SELECT string_agg({block(content='body')}, '' ORDER BY {order}) FROM {table} x "
            f"WHERE x.repo = p.repo AND regexp_matches(body, '\\S') AND {condition}), '')"
        )

    def earlier(step: int, default: str) -> str:
        return (
            f"coalesce((SELECT nullif({strip('output')}, '') FROM corpus_outputs o WHERE o.repo = p.repo AND step = {step}), {q(default)})"
        )

    one = {
        **shared, "formatted_analysis": "r.text",
        "entry_points": "coalesce('## Entry Points\n' || entries, '')",
        "key_components": "CASE WHEN key_project_files <> '' THEN '## Key Components\n- ' || replace(key_project_files, '|', '\n- ') ELSE '' END",
        "key_files_content": blocks("picked_1"),
    }
    two = {
        **shared,
        "config_files": blocks("configs", f"is_gathered AND rn <= {fv.CONFIGS_IN_STEP_2}", "rn"),
        "shell_scripts": "coalesce('## Shell Scripts\n' || shells, '')",
        "root_shell_scripts": "coalesce('## Root Shell Scripts\n' || roots, '')",
        "run_commands": "'### Build Commands\n' || coalesce(all_cmds, '')",
    }
    three = {
        **shared, "project_purpose": earlier(1, fv.NO_PURPOSE), "usage_instructions": earlier(2, fv.NO_USAGE),
    }
    four = {
        **shared, "build_system": "type",
        "readme_recommendation": f"CASE WHEN is_low_quality THEN {q(fv.OVERWRITE)} ELSE {q(fv.RESPECT_ORIGINAL)} END",
        "readme_evaluation": f"CASE WHEN length(reason) > {fv.EVALUATION_CHARS} THEN substr(reason, 1, {fv.EVALUATION_KEPT}) || '...' ELSE reason END",
        "original_readme": "original_readme", "generated_readme": "generated_readme",
    }
    source = "FROM profiles p JOIN lines l USING (repo) JOIN reports r USING (repo) JOIN optimized o USING (repo)"
    return " UNION ALL ".join(
        f"SELECT p.repo, CAST({step} AS INTEGER) AS step, {fill(step, values)} AS prompt {source}"
        for step, values in {1: one, 2: two, 3: three, 4: four}.items()
    )


def _kept(table: str, step: int, field: str, condition: str = "true") -> str:
    return (
        f"SELECT repo, CAST({step} AS INTEGER) AS step, '{field}' AS field, path, md5(body) AS digest "
        f"FROM {table} WHERE regexp_matches(body, '\\S') AND {condition}"
    )


def _category_picks() -> str:
    """Greedy picks, one table per category, each without the files picked before."""
    tests = {
        "build": f"{has(LOWER, ['gradle', 'pom'])}", "config": CONFIG,
        "docs": f"ends_with({LOWER}, '.md')", "code": ends(LOWER, [".java", ".py", ".js"]),
    }
    extra, taken = {}, []
    for number, (name, test) in enumerate(tests.items()):
        others = "".join(f" AND NOT EXISTS (SELECT 1 FROM {t} t WHERE t.repo = r.repo AND t.path = r.path)" for t in taken)
        extra[f"pick_{name}"] = (
            f"SELECT repo, path, {number} AS turn, row_number() OVER (PARTITION BY repo ORDER BY score DESC, ord) AS k "
            f"FROM ranked r WHERE {test}{others} QUALIFY k <= 2"
        )
        taken.append(f"pick_{name}")
    union = " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken)
    extra["picks"] = union
    extra["filled"] = (
        "SELECT * FROM picks UNION ALL SELECT repo, path, 9, rn FROM ranked r "
        "WHERE NOT EXISTS (SELECT 1 FROM picks t WHERE t.repo = r.repo AND t.path = r.path)"
    )
    return sql(
        "SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY turn, k) AS INTEGER) AS position, path "
        "FROM filled QUALIFY position <= 8",
        **extra,
    )


def _artifacts() -> str:
    name = (
        "CASE step " + " ".join(f"WHEN {n} THEN {q(s)}" for n, s in fv.STEP_NAMES.items())
        + " ELSE 'step-' || step END"
    )
    m = rq.MODEL
    return (
        f"SELECT repo, step, printf('step_%02d_output.md', step) AS step_name, "
        f"printf('step_%02d_%s_output_%s_{m}.md', step, {name}, repo) AS output_name, "
        f"repo || '_step' || step || '_' || {name} || '_context_{m}.json' AS context_name, "
        f"repo || '_step' || step || '_' || {name} || '_prompt_{m}.log' AS prompt_name, "
        f"repo || '_step' || step || '_' || {name} || '_reasoning_{m}.md' AS reasoning_name, "
        f"repo || '_repo_context_{m}.json' AS profile_name, repo || '_ai.README.md' AS final_name, "
        "repo || '_reasoning.md' AS final_reasoning_name FROM step_outputs"
    )


def _lists() -> str:
    conditions = {
        "entry_points": "is_entry", "config_files": "is_config OR is_example",
        "example_config_files": "is_example", "key_project_files": "is_gathered AND is_key",
        "shell_scripts": f"is_gathered AND {SHELL}", "root_shell_scripts": f"is_gathered AND {ROOT_SHELL}",
        "readme_files": f"is_gathered AND {README}",
        "java_files": "is_gathered AND analyzer = 'java' AND lang = 'Java'",
        "gradle_files": "is_gathered AND analyzer = 'java' AND (lang = 'Gradle' OR ends_with(path, '.gradle'))",
        "python_files": "is_gathered AND analyzer = 'python' AND lang = 'Python'",
    }
    return " UNION ALL ".join(
        f"SELECT repo, '{name}' AS list, path FROM survey WHERE {test}" for name, test in conditions.items()
    )


def _list_order() -> str:
    """Places in the lists: those of a language and the READMEs by score, the others as found."""
    found = {
        "entry_points": ("is_entry", "ord"),
        "config_files": ("is_config OR is_example", "CASE WHEN is_config THEN '0' || ord ELSE '1' || path END"),
        "example_config_files": ("is_example", "path"), "key_project_files": ("is_gathered AND is_key", "ord"),
        "shell_scripts": (f"is_gathered AND {SHELL}", "ord"), "root_shell_scripts": (f"is_gathered AND {ROOT_SHELL}", "ord"),
    }
    scored = {
        "readme_files": README, "java_files": "analyzer = 'java' AND lang = 'Java'",
        "gradle_files": "analyzer = 'java' AND (lang = 'Gradle' OR ends_with(path, '.gradle'))",
        "python_files": "analyzer = 'python' AND lang = 'Python'",
    }
    rows = [f"SELECT repo, '{name}' AS list, path, 0 AS fall, {order} AS place FROM survey WHERE {test}" for name, (test, order) in found.items()]
    rows += [f"SELECT repo, '{name}', path, -score, ord FROM scored WHERE {test}" for name, test in scored.items()]
    union = " UNION ALL ".join(rows)
    return (
        "SELECT repo, list, path, CAST(row_number() OVER (PARTITION BY repo, list ORDER BY fall, place) AS INTEGER) AS rank "
        f"FROM ({union})"
    )


def _content_score() -> str:
    whens = " ".join(
        f"WHEN ends_with({LOWER}, {q(ext)}) THEN " + " + ".join(f"{count('content', r)} * {w}" for r, w in rules.items())
        for ext, rules in rq.CONTENT_SCORES.items()
    )
    return f"CASE {whens} ELSE 0 END"


def _words(content: str, lower: bool) -> str:
    items = [(w.lower() if lower else w) for w in rq.WORDS]
    hits = ", ".join(f"CASE WHEN contains({content}, {q(w)}) THEN {q(w)} END" for w in items)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def _quality_rules() -> str:
    body = strip("content")
    signs = {name: f"regexp_matches(content, {q(regex)})" for name, regex in fv.QUALITY_SIGNS.items()}
    signs["very_short"] = f"length({body}) < {fv.MIN_README_CHARS}"
    signs["one_line"] = f"NOT contains({body}, {q(chr(10))})"
    signs["only_a_link"] = f"regexp_matches(content, {q(fv.ONLY_A_LINK)})"
    columns = ", ".join(f"{text} AS {name}" for name, text in signs.items())
    total = " + ".join(f"CAST({name} AS INTEGER)" for name in signs)
    return f"SELECT *, {total} AS n_signs FROM (SELECT repo, path, {columns} FROM files WHERE {README})"


EXAMPLES = """    EXAMPLE 1:
    ```
    # untitled

    Some text will follow.
    ```

    EXAMPLE 2:
    ```
    Moved here from the old server, see the chat for how to start it.
    ```

    EXAMPLE 3:
    ```
    # Weather

    ## Install

    tbd

    ## Use

    tbd
    ```
"""


def _evaluation() -> str:
    head, tail = "'{readme_content}'", "'{generated_readme}'"
    text = f"replace({q(fv.EVALUATION_TEMPLATE)}, '{{samples}}', {q(EXAMPLES)})"
    return (
        f"SELECT repo, split_part({text}, {head}, 1) || original_readme || "
        f"split_part(split_part({text}, {head}, 2), {tail}, 1) || generated_readme || "
        f"split_part(split_part({text}, {head}, 2), {tail}, 2) AS prompt "
        f"FROM made_pairs p WHERE NOT {_minimal('p')}"
    )


def _step_files() -> str:
    return (
        "SELECT repo, 'prompts/default/' || lpad(CAST(k % 6 AS VARCHAR), 2, '0') || '-step' || k || "
        "CASE WHEN k % 5 = 4 THEN '.SKIP' ELSE '' END || CASE WHEN k % 7 = 6 THEN '.txt' ELSE '.md' END AS path "
        "FROM (SELECT repo, (doc_id // 20) % 16 AS k FROM files_id)"
    )


def _combined(found: dict[str, str]) -> dict[str, str]:
    """SQL made of other queries' SQL."""
    base = {
        "name": "repo", "language": "primary_language", "is_spring_boot": "CAST(has_spring_boot AS VARCHAR)", "build_system": "type",
    }
    facts = " UNION ALL ".join(f"SELECT repo, '{f}' AS field, '' AS path, {v} AS content FROM profiles" for f, v in base.items())
    shared = sql(
        f"{facts} UNION ALL SELECT repo, 'custom_tools', '', tool FROM tools "
        "UNION ALL SELECT repo, 'file_breakdown', '', lang || ': ' || n FROM stats "
        "UNION ALL SELECT repo, 'entry_points', path, NULL FROM survey WHERE is_entry "
        f"UNION ALL SELECT repo, 'shell_scripts', path, NULL FROM survey WHERE is_gathered AND {SHELL} "
        f"UNION ALL SELECT repo, 'shell_scripts', path, NULL FROM survey WHERE is_gathered AND {ROOT_SHELL} "
        f"UNION ALL SELECT repo, 'existing_readme', path, body FROM survey WHERE is_gathered AND {README} "
        "UNION ALL SELECT repo, 'formatted_analysis', '', text FROM reports"
    )
    steps = ", ".join(map(str, range(5)))
    rows = [f"SELECT repo, step, field, path, md5(coalesce(content, '')) AS digest FROM ({shared}), (SELECT unnest([{steps}]) AS step)"]
    rows.append(f"SELECT repo, step, field, path, digest FROM ({found['c3_purpose_context']}) WHERE field <> 'formatted_analysis'")
    rows.append(f"SELECT repo, step, field, path, digest FROM ({found['c4_usage_context']}) WHERE field NOT IN ('shell_scripts', 'root_shell_scripts')")
    rows.append(f"SELECT repo, step, field, path, digest FROM ({found['c5_draft_context']})")
    for field in ("original_readme", "generated_readme", "readme_evaluation", "readme_recommendation", "is_low_quality"):
        rows.append(f"SELECT repo, 4, '{field}', '', md5(coalesce(CAST({field} AS VARCHAR), '')) FROM ({found['c6_optimize_context']})")
    contexts = " UNION ALL ".join(rows)
    every = "SELECT repo || '/' || path AS repo, doc_id, content FROM files_id WHERE " + ORIGINAL
    own = {
        "made_pairs": f"SELECT repo, CASE WHEN doc_id % 7 = 0 THEN '  # tiny\n' ELSE content END AS original_readme, '# ' || repo AS generated_readme FROM ({every})",
        "verdicts": (
            "SELECT repo, CASE WHEN quality = 1 THEN 'Good.\nNO' ELSE 'Poor.\nYES' END AS output "
            f"FROM ({every}) JOIN labels USING (doc_id)"
        ),
    }
    quality = (
        f"SELECT repo, low AS is_low_quality, CASE WHEN low THEN 'OVERWRITE' ELSE 'RESPECT_ORIGINAL' END AS recommendation, reason FROM ("
        f"SELECT p.repo, {_low('p')} AS low, CASE WHEN {_minimal('p')} THEN {q(fv.MINIMAL_README_REASON)} "
        f"ELSE coalesce(v.output, {q(fv.EVALUATION_ERROR)}) END AS reason FROM made_pairs p LEFT JOIN verdicts v USING (repo))"
    )
    facts = ("analyzer", "primary_language", "total_files", "n_config_files", "type")
    saved = " UNION ALL ".join(f"SELECT repo, '{f}' AS name, 0 AS position, CAST({f} AS VARCHAR) AS value FROM profiles" for f in facts)
    saved = sql(
        f"{saved} UNION ALL SELECT repo, 'top_files', CAST(rn AS INTEGER), path || ':' || lang || ':' || score FROM ranked WHERE rn <= {fv.TOP_FILES_IN_PROFILE} "
        "UNION ALL SELECT repo, 'custom_tools', CAST(row_number() OVER (PARTITION BY repo ORDER BY seen) AS INTEGER), tool FROM tools"
    )
    return {
        "c7_step_contexts": contexts,
        "k1_write_all_contexts": f"SELECT * FROM ({contexts}) WHERE step > 0",
        "k3_write_all_prompts": found["c10_build_prompts"],
        "c8_every_readme_quality": sql(quality, **own),
        "c11_every_evaluation_prompt": sql(_evaluation(), **own),
        "k2_saved_profile": f"SELECT * FROM ({saved}) UNION ALL SELECT repo, list, rank, path FROM ({found['a6_list_order']})",
    }


def oracle_sql() -> dict[str, str]:
    text_4, comments_4 = reasoning("output")
    text_html, comments_html = reasoning("html")
    by_repo = "FROM ranked"
    deps_java = "SELECT d.*, a.analyzer FROM deps d JOIN analyzers a USING (repo)"
    purpose = _kept("picked_1", 1, "key_files_content")
    found = {
        "u1_language_plugin": plugin_sql(
            "SELECT repo, analyzer, path, lang AS language, is_key AS is_key_file, is_entry AS is_entry_point, "
            "is_config, CAST(score AS INTEGER) AS importance_score FROM classified"
        ),
        "u1_plugin_profile": plugin_sql(
            "SELECT repo, analyzer, CASE WHEN bool_or(lang = 'Java') THEN 'Java' ELSE (SELECT lang FROM classified d "
            "WHERE d.repo = c.repo GROUP BY lang ORDER BY count(*) DESC, min(ord) LIMIT 1) END AS primary_language, "
            "count(*) AS total_files, count_if(is_entry) AS n_entry_points, arg_min(path, (-score, ord)) AS best_file, "
            "count_if(analyzer = 'scripts' AND lang = 'Markdown' AND regexp_matches(body, '\\S')) AS n_notes, "
            f"CASE WHEN analyzer = 'scripts' THEN CAST(sum({count('body', 'the ')}) AS VARCHAR) ELSE '' END AS articles, "
            "CASE WHEN analyzer = 'scripts' THEN CAST(max(size) AS VARCHAR) ELSE '' END AS largest "
            "FROM classified c GROUP BY repo, analyzer"
        ),
        "s1_scan_repos": sql(f"SELECT repo, path, size, {DIGEST} AS digest FROM files"),
        "s1_archive_members": sql(f"SELECT source AS repo, inside AS path, size, {DIGEST} AS digest FROM ({STORED})"),
        "s1_hidden_names": sql(
            "SELECT source AS repo, CASE doc_id % 3 WHEN 0 THEN inside WHEN 1 THEN inside || '/.eslintrc' "
            f"ELSE '_lib/' || inside || '/__main__.py' END AS path, size, {DIGEST} AS digest FROM ({STORED})"
        ),
        "s1_truncated_archives": sql(
            f"SELECT source AS repo, inside AS path, size, {DIGEST} AS digest, false AS failed FROM ({HALVES}) WHERE until <= half "
            f"UNION ALL SELECT DISTINCT source, source || '.tar', half, md5(''), true FROM ({HALVES})"
        ),
        "s5_unreadable_files": sql(
            f"SELECT source AS repo, inside AS path, size, 'Unknown' AS language, size <= {rq.SMALL} AS has_content, "
            f"md5(CASE WHEN size <= {rq.SMALL} THEN content ELSE '' END) AS digest, false AS failed FROM ({HALVES}) WHERE until <= half "
            f"UNION ALL SELECT DISTINCT source, source || '.tar', -1, '', false, md5(''), true FROM ({HALVES})"
        ),
        "s2_read_text": sql(
            f"SELECT repo, path, size, md5(content || '\nnext\nlast\n') AS digest FROM files WHERE size <= {rq.SMALL}"
        ),
        "s3_find_by_extension": sql(
            f"SELECT repo, path FROM files WHERE {ends('path', ['.java', '.yml', '.py', '.md'])} AND NOT {excluded()}"
        ),
        "s4_find_by_pattern": sql(f"SELECT repo, path FROM files WHERE contains({NAME}, 'er') AND NOT {excluded()}"),
        "s5_file_info": sql(
            "SELECT repo, path, size, false AS is_key_file, false AS is_entry_point, false AS is_config, 'Unknown' AS language, "
            f"size <= {rq.SMALL} AS has_content, md5(CASE WHEN size <= {rq.SMALL} THEN content ELSE '' END) AS digest, '' AS error FROM files"
        ),
        "s6_scan_step_templates": sql(
            f"SELECT repo, CAST(substr({NAME}, 1, 2) AS INTEGER) AS step, substr({NAME}, 4, length({NAME}) - 6) AS name, path "
            f"FROM ({_step_files()}) WHERE ends_with(path, '.md') AND NOT contains(path, '.SKIP.') AND substr({NAME}, 1, 2) <> '00'"
        ),
        "s7_scan_step_outputs": sql("SELECT repo, step, output FROM step_outputs WHERE step < 3 AND output <> ''"),
        "k1_write_contexts": sql(purpose),
        "k2_write_profile": sql(
            "SELECT repo, analyzer, primary_language, total_files, has_spring_boot, "
            f"CAST(least(total_files, {fv.TOP_FILES_IN_PROFILE}) AS INTEGER) AS n_top_files FROM profiles"
        ),
        "k3_write_prompts": sql(f"SELECT * FROM ({_prompts()}) WHERE step = 3"),
        "k4_write_step_outputs": sql(
            f"SELECT repo, step, md5(CASE WHEN step = 4 THEN {text_4} ELSE output END) AS digest, "
            f"CASE WHEN step = 4 THEN {comments_4} ELSE '-' END AS reasoning FROM page_outputs"
        ),
        "k5_write_readmes": sql(f"SELECT repo, md5({watermark('output')}) AS digest FROM page_outputs"),
        "k6_artifact_name": sql(_artifacts()),
        "p1_exclude_dirs": flags(
            by_segment=excluded(), by_substring=has(DIR, fv.EXCLUDED_DIRS), own_dirs=excluded(["com", "docs"])
        ),
        "p2_analyzable": flags(
            java=analyzable("java"), python=analyzable("python"), javascript=analyzable("javascript"),
            java_strict=analyzable("java", False),
        ),
        "p3_key_file": flags(java=key_file("java"), python=key_file("python"), javascript=key_file("javascript")),
        "p4_is_sonar": flags(flag=SONAR),
        "p5_is_ci_file": flags(flag="path = 'README.md'"),
        "p6_is_config": flags(flag=CONFIG),
        "p7_is_config_lite": flags(flag=CONFIG_LITE),
        "p8_is_shell": flags(is_shell=SHELL, is_root_shell=ROOT_SHELL),
        "p9_is_example_config": flags(by_path=EXAMPLE, by_name=EXAMPLE_NAME),
        "p10_is_special_config": flags(special=SPECIAL, config=f"{CONFIG} OR {SPECIAL}"),
        "p11_is_entry_point": sql("SELECT repo, path, is_entry AS is_entry_point FROM survey WHERE is_gathered"),
        "p12_is_readme": flags(flag=README),
        "p13_is_original_readme": flags(flag=ORIGINAL),
        "p14_non_blank": (
            "SELECT doc_id, text IS NOT NULL AND regexp_matches(text, '\\S') AS text, "
            "text IS NOT NULL AND regexp_matches(text, '\\S') AND doc_id % 5 <> 0 AS blanked FROM documents"
        ),
        "p15_contains_any": (
            f"SELECT doc_id, array_to_string({_words('text', False)}, ',') AS exact, "
            f"array_to_string({_words('lower(text)', True)}, ',') AS any_case FROM documents"
        ),
        "p16_has_framework": flags(
            flag=f"{language('java')} = 'Java' AND contains(content, {q(fv.BOOT_ANNOTATION)})"
        ),
        "j1_merge_passes": sql(
            f"SELECT DISTINCT repo, path, size FROM files WHERE {key_file('java')} OR ({analyzable('java')} AND NOT {excluded()})"
        ),
        "j2_content_lookup": sql(
            f"SELECT repo, path, CAST(rn AS INTEGER) AS rank, {DIGEST} AS digest {by_repo} WHERE rn <= 5 AND regexp_matches(content, '\\S')"
        ),
        "j3_key_paths": sql(f"SELECT repo, path {by_repo} WHERE is_entry OR is_key OR rn <= 3"),
        "j4_config_union": sql("SELECT repo, path, CAST(rn AS INTEGER) AS rank FROM configs WHERE rn <= 4"),
        "j5_split_key_files": sql(f"SELECT repo, path, {CATEGORY} AS category FROM survey WHERE is_gathered AND is_key"),
        "j6_readme_pair": sql("SELECT * FROM pairs"),
        "j7_attach_completions": sql(
            "SELECT s.repo, s.step, md5(s.output) AS asked, coalesce(c.output, '') AS output, false AS failed FROM step_outputs s LEFT JOIN completions c USING (repo, step) "
            "UNION ALL SELECT repo, step, '', '', true FROM step_outputs WHERE (repo, step) NOT IN (SELECT repo, step FROM completions)"
        ),
        "j8_pending_repos": sql(
            "SELECT repo, CAST(s AS INTEGER) AS step FROM (SELECT DISTINCT repo FROM step_outputs), range(1, 5) t(s) "
            "WHERE (repo, s) NOT IN (SELECT repo, step FROM completions WHERE output <> '')"
        ),
        "a1_language_stats": sql("SELECT repo, lang AS language, n FROM stats"),
        "a2_language_breakdown": sql(
            "SELECT repo, analyzer, lang AS language, n FROM stats JOIN analyzers USING (repo) ORDER BY repo, n DESC, first"
        ),
        "a3_primary_language": sql("SELECT * FROM main_language"),
        "a4_select_analyzer": sql("SELECT * FROM analyzers"),
        "a5_repo_counts": sql("SELECT * FROM counts"),
        "a6_repo_lists": sql(_lists()),
        "a6_list_order": sql(_list_order()),
        "a7_content_maps": sql(f"SELECT repo, path, {DIGEST} AS digest FROM survey WHERE is_gathered AND {README}"),
        "a8_custom_tools": sql("SELECT repo, tool FROM tools"),
        "a8_tool_order": sql(
            "SELECT repo, tool, CAST(row_number() OVER (PARTITION BY repo ORDER BY seen) AS INTEGER) AS rank FROM tools"
        ),
        "a9_build_system": sql("SELECT b.* FROM builds b JOIN analyzers USING (repo) WHERE analyzer = 'java'"),
        "a10_last_completed_step": sql("SELECT repo, max(step) AS step FROM completions WHERE output <> '' GROUP BY repo"),
        "a11_combine_outputs": sql(
            "SELECT repo, string_agg(output, '\n\n' ORDER BY step) AS text FROM step_outputs WHERE step < 4 AND output <> '' GROUP BY repo"
        ),
        "a12_group_api": sql(
            "SELECT repo, type, string_agg(line, '\n' ORDER BY page_id) AS lines FROM api GROUP BY repo, type"
        ),
        "a13_mapping_annotations": flags(
            mappings=f"CAST({count('content', fv.MAPPINGS)} AS INTEGER)",
            stereotypes=f"CAST({count('content', fv.STEREOTYPES)} AS INTEGER)",
        ),
        "a14_command_groups": sql("SELECT repo, kind, command FROM commands"),
        "a14_command_order": sql(
            "SELECT repo, kind, command, CAST(pos AS INTEGER) AS rank FROM commands",
            files=(
                "SELECT repo, path, CAST(strlen(content) AS BIGINT) AS size, content FROM files_id UNION ALL "
                "SELECT repo, p, strlen(content), content FROM files_id, (VALUES ('a-stop.sh'), ('main-run.sh'), ('start-config.sh')) t(p) "
                "WHERE path = 'start-local.sh'"
            ),
        ),
        "r1_score_base": sql(f"SELECT repo, path, {base_score()} AS score FROM survey WHERE is_gathered"),
        "r2_score_java": java_sql("SELECT repo, path, CAST(score AS INTEGER) AS score FROM scored"),
        "r3_score_understanding": java_sql(
            f"SELECT repo, path, CAST({base_score()} + {code_score()} AS INTEGER) AS score FROM survey WHERE is_gathered"
        ),
        "r4_score_by_criteria": flags(score=f"CAST({criteria(rq.CRITERIA)} AS INTEGER)"),
        "r5_score_by_type": flags(score=f"CAST({first_suffix(rq.TYPE_SCORES)} AS INTEGER)"),
        "r6_score_by_content": flags(score=f"CAST({_content_score()} AS INTEGER)"),
        "r7_score_combined": flags(score=f"CAST({criteria(rq.CRITERIA)} + {first_suffix(rq.TYPE_SCORES)} AS INTEGER)"),
        "r8_sort_by_importance": sql(
            f"SELECT repo, path, CAST({criteria(rq.CRITERIA)} AS INTEGER) AS importance_score FROM files "
            f"ORDER BY repo, importance_score DESC, CASE WHEN {key_file('java')} THEN 0 ELSE 1 END, path"
        ),
        "r9_top_n": sql(
            f"SELECT repo, path, CAST(score AS INTEGER) AS importance_score, CAST(rn AS INTEGER) AS rank {by_repo} WHERE rn <= 10"
        ),
        "r10_top_by_category": _category_picks(),
        "r11_cap_with_overflow": sql(
            "SELECT repo, CAST(rn AS INTEGER) AS position, text AS line FROM deps WHERE rn <= 2 UNION ALL "
            "SELECT DISTINCT repo, 3, '... and ' || (total - 2) || ' more' FROM deps WHERE total > 2"
        ),
        "r12_priority_order": sql(
            "SELECT repo, path, CASE WHEN path = 'build.gradle' THEN 0 WHEN is_entry THEN 1 ELSE 2 END AS priority "
            "FROM survey WHERE is_gathered ORDER BY repo, priority, ord"
        ),
        "f1_detect_language": flags(java=language("java"), python=language("python"), javascript=language("javascript")),
        "f2_path_parts": flags(name=NAME, dir=DIR, suffix=SUFFIX, relative="path"),
        "f3_extract_patterns": "SELECT doc_id, " + ", ".join(
            f"array_to_string(regexp_extract_all(text, {q('(?s)' + regex)}, {1 if '(' in regex else 0}), '|') AS {name}"
            for name, regex in rq.NAMED_PATTERNS.items()
        ) + " FROM documents",
        "f4_extract_reasoning": f"SELECT page_id, md5({text_html}) AS digest, {comments_html} AS reasoning FROM pages",
        "f5_fold_newlines": flags(digest=f"md5({fold('content')})"),
        "f6_strip_fence": sql(f"SELECT conv_id, turn, {fence_stripped('text')} AS text FROM fenced"),
        "f7_truncate": (
            "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 997) || '...' ELSE text END AS evaluation, "
            "CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '\n... (see detailed analysis for more)' ELSE text END AS usage FROM documents"
        ),
        "f8_parse_verdict": (
            f"SELECT conv_id, turn, {verdict('answer')} AS verdict FROM (SELECT conv_id, turn, text || "
            "CASE turn WHEN 1 THEN '\n yes \n' WHEN 2 THEN '\nNO' WHEN 3 THEN '\nYES or NO, it Should be replaced' ELSE '\nunclear ' END AS answer "
            "FROM conversations)"
        ),
        "f9_gradle_dependencies": sql(
            "SELECT repo, path, config, group_id, artifact, version, text FROM gradle_deps UNION ALL "
            f"SELECT repo, path, config, group_id, artifact, version, text FROM ({_dependency(2, fv.GRADLE_DEPENDENCY_PAREN)})"
        ),
        "f10_maven_dependencies": sql("SELECT repo, path, config, group_id, artifact, version, text FROM maven_deps"),
        "f11_gradle_plugins": sql(
            "SELECT repo, path, 'all' AS mode, unnest(regexp_extract_all(b, "
            f"{q(fv.PLUGIN_ID)}, 1)) AS plugin FROM (SELECT repo, path, unnest(regexp_extract_all(content, {q(fv.PLUGIN_BLOCK)})) AS b "
            "FROM files WHERE ends_with(path, '.gradle')) UNION ALL "
            f"SELECT repo, path, 'last', unnest(regexp_extract_all(content, {q(fv.PLUGIN_LAST_ID)}, 1)) FROM files WHERE ends_with(path, '.gradle')"
        ),
        "f12_script_command": sql(f"SELECT repo, path, {KIND} AS kind, './' || path AS command FROM files WHERE {KIND} IS NOT NULL"),
        "f13_watermark": f"SELECT page_id, md5({watermark('html')}) AS digest FROM pages",
        "f14_bullet_lines": (
            f"SELECT doc_id, CASE WHEN len(w) > 0 THEN '- ' || array_to_string(w, '\n- ') ELSE 'None found' END AS lines "
            f"FROM (SELECT doc_id, {_words('text', False)} AS w FROM documents)"
        ),
        "f15_fenced_block": flags(digest=f"md5({block()})"),
        "f16_render_template": flags(
            digest="md5('# ' || repo || '\n' || size || ' bytes at ' || path || '\n' || repo || ': ' || content)"
        ),
        "f17_flag_sentence": flags(sentence=f"CASE WHEN {CONFIG} THEN 'It configures.' ELSE '' END"),
        "c1_profile_repos": sql(
            "SELECT * EXCLUDE (other_keys, config_keys, example_keys, tools_shown, languages_shown) FROM profiles"
        ),
        "c2_profile_report": sql("SELECT repo, with_api AS text FROM reports"),
        "c2_quick_start_report": sql("SELECT repo, quick AS text FROM reports"),
        "c3_purpose_context": sql(
            f"{purpose} UNION ALL SELECT repo, 1, 'formatted_analysis', '', md5(text) FROM reports"
        ),
        "c3_purpose_context_all": sql(_kept("ranked", 1, "key_files_content")),
        "c4_usage_context": sql(
            " UNION ALL ".join(
                [
                    _kept("ranked", 2, "key_files_content",
                          f"(is_entry OR path IN ('build.gradle', 'docker-compose.yml') OR contains({LOWER}, 'controller'))"),
                    _kept("configs", 2, "config_files", f"is_gathered AND rn <= {fv.CONFIGS_IN_STEP_2}"),
                    _kept("ranked", 2, "example_configs", "is_example"),
                    "SELECT repo, 2, 'run_commands', kind, md5(command) FROM commands",
                    f"SELECT repo, 2, 'shell_scripts', path, md5('') FROM survey WHERE is_gathered AND {SHELL}",
                    f"SELECT repo, 2, 'root_shell_scripts', path, md5('') FROM survey WHERE is_gathered AND {ROOT_SHELL}",
                ]
            )
        ),
        "c5_draft_context": sql(
            " UNION ALL ".join(
                [
                    _kept("picked_3", 3, "key_files_content"),
                    f"SELECT repo, 3, CASE step WHEN 1 THEN 'project_purpose' ELSE 'usage_instructions' END, '', md5({strip('output')}) "
                    f"FROM corpus_outputs WHERE step IN (1, 2) AND {strip('output')} <> ''",
                    f"SELECT repo, 3, 'dependencies', '', md5(text) FROM ({deps_java}) WHERE analyzer = 'java' AND rn <= {fv.DEPENDENCIES_SHOWN}",
                    "SELECT repo, 3, 'entry_points_formatted', path, md5('- ' || path) FROM survey WHERE is_entry",
                ]
            )
        ),
        "c6_optimize_context": sql(
            "SELECT repo, original_readme, generated_readme, reason AS readme_evaluation, "
            "CASE WHEN is_low_quality THEN 'OVERWRITE' ELSE 'RESPECT_ORIGINAL' END AS readme_recommendation, is_low_quality FROM optimized"
        ),
        "c7_base_context": sql(
            "SELECT repo, repo AS name, primary_language AS language, has_spring_boot AS is_spring_boot, type AS build_system, "
            "replace(custom_tools, '|', ',') AS custom_tools, replace(language_stats, '|', ',') AS file_breakdown FROM profiles"
        ),
        "c8_readme_quality": sql(
            f"SELECT repo, low AS is_low_quality, CASE WHEN low THEN 'OVERWRITE' ELSE 'RESPECT_ORIGINAL' END AS recommendation, reason FROM ("
            f"SELECT p.repo, {_low('p')} AS low, CASE WHEN {_minimal('p')} THEN {q(fv.MINIMAL_README_REASON)} "
            f"ELSE coalesce(v.output, {q(fv.EVALUATION_ERROR)}) END AS reason FROM made_pairs p LEFT JOIN verdicts v USING (repo))"
        ),
        "c9_readme_quality_rules": sql(_quality_rules()),
        "c10_build_prompts": sql(_prompts()),
        "c10_streamed_prompts": sql(_prompts()),
        "u4_streamed_completions": sql(
            f"SELECT repo, step, repo || '/' || step || ': ' || md5(prompt) AS output FROM ({_prompts()})"
        ),
        "c11_evaluation_prompts": sql(_evaluation()),
        "c12_plan_steps": sql(
            "SELECT repo, CAST(s AS INTEGER) AS step, 'resume' AS run FROM (SELECT DISTINCT repo FROM step_outputs) "
            "LEFT JOIN (SELECT repo, max(step) AS last FROM completions WHERE output <> '' GROUP BY repo) USING (repo), range(1, 5) t(s) "
            "WHERE s > CASE WHEN last BETWEEN 1 AND 4 THEN last ELSE 0 END UNION ALL "
            "SELECT repo, s, 'from' FROM (SELECT DISTINCT repo FROM step_outputs), range(3, 5) t(s) UNION ALL "
            "SELECT DISTINCT repo, 2, 'only' FROM step_outputs"
        ),
        "c13_finalize": sql(
            f"SELECT repo, md5({watermark("(" + text_4 + ")")}) AS digest, {comments_4} AS reasoning FROM page_outputs WHERE step = 4"
        ),
    }
    return found | _combined(found)
