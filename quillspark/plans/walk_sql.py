"""The normaliser's rules as DuckDB SQL: what the walk is checked against.

It shares the rules' fixed tables with the walk and nothing else: pieces are matches of one pattern, characters are composed by
Unicode's rule, specials are protected and put back. Lists in tables (R7) and descriptions of drawings beyond ASCII don't come in the
tables that it is used on, and are left out.
"""

from __future__ import annotations

from quillspark.operators import normalize


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens() -> str:
    """A pattern whose matches, one behind the other, are the pieces of the walk; \\x01 stands behind each escape, so that a macro's name has an end.

    Groups and options may hold one more level of their kind; deeper ones are beyond a pattern.
    """
    names = lambda xs: "|".join(sorted(xs, key=len, reverse=True))

    def balanced(o: str, c: str) -> str:
        inner = rf"(?:\\.|[^\\{o}{c}])*"
        return rf"\s*{o}(?:\\.|[^\\{o}{c}]|{o}{inner}{c})*{c}"

    opt, grp = (rf"(?:{balanced(o, c)}|\s*{o}.*)" for o, c in ((r"\[", r"\]"), (r"\{", r"\}")))
    skip = r"(?:\\.|[^\\]|\\\z)*?"
    envs = "|".join(rf"\\begin\x01\{{{e}\}}.*?(?:\\\x01?end\x01?\{{{e}\}}|\z)" for e in sorted(n.replace("*", r"\*") for n in normalize.MATH_ENVS))
    wide = [m for m in normalize.ARGUMENTS if m in ("sqrt", "xrightarrow", "xleftarrow")]
    one = [m for m, n in normalize.ARGUMENTS.items() if n == 1 and m not in wide]
    bare = [m for m in normalize.MATH_ONLY if m not in normalize.ARGUMENTS]
    return "(?s)" + "|".join([
        rf"\$\${skip}(?:\$\$|\z)", rf"\${skip}(?:\$|\z)",
        r"\\\(\x01.*?(?:\\\x01?\)|\z)", r"\\\[\x01.*?(?:\\\x01?\]|\z)", envs,
        rf"\\begin\x01\{{(?:tabular|array|tabularx|minipage|multicols)\}}{opt}?{grp}?", rf"\\begin\x01\{{[^}}]*\}}{opt}?", r"\\end\x01\{[^}]*\}",
        rf"\\(?:{names(wide)})\*?\x01{opt}?{grp}?", rf"\\frac\*?\x01{grp}?{grp}?", rf"\\(?:{names(one)})\*?\x01{grp}?", rf"\\(?:{names(bare)})\*?\x01",
        rf"\\(?:{names(normalize.NAME_ARGUMENTS)})\*?\x01(?:{opt}|{grp})*", rf"\\[a-zA-Z]+\*?\x01{opt}?",
        r"\\.\x01", r"%[^\n]*", r"[{}]", r"[^\\$%{}]+", r"\\",
    ])


_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho - sigma tau upsilon phi chi psi omega".split()

def latex_rows() -> str:
    """Characters with LaTeX of their own: the fixed tables, and Greek by its place in Unicode."""
    fixed = [(c, v if not v.startswith("\\") else f"{{{v}}}") for c, v in normalize.SIGNS.items()] + [(c, f"\\ensuremath{{{v}}}") for c, v in normalize.MATH_SIGNS.items()]
    fixed += [(chr(at + i), f"\\ensuremath{{\\{n if at > 920 else n.capitalize()}}}") for at in (945, 913) for i, n in enumerate(_GREEK) if n != "-"]
    return ", ".join(f"({q(c)}, {q(v)})" for c, v in fixed)


_ACC = ", ".join(f"({k}, {q(v)})" for k, v in normalize.ACCENTS.items())
_DIAGRAM = r"(?s)\[\[(DIAGRAM|FABRICATED):\s*(.*?)\]\]"
_GRAPHIC = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}"
_BREAK = r"(?m)(\\end\{[^}]+\}[ \t]*)\\\\|^[ \t]*\\\\[ \t]*$"
_ONLY = "|".join(normalize.MATH_ONLY)


def walked(source: str, strip_envs: str, envs: str) -> str:
    """Common table expressions that end in walked (doc_id, s, n): text of the table source (doc_id, t) without its frame, and how many rules fired."""
    return rf"""
latex AS (
    SELECT * FROM (VALUES {latex_rows()}) v(c, l) UNION ALL
    SELECT nfc_normalize(chr(b::INT) || chr(m)) AS c, '\' || s || '{{' || CASE WHEN chr(b::INT) IN ('i', 'j') AND s <> 'c' THEN '\' ELSE '' END || chr(b::INT) || '}}' AS l
    FROM range(33, 127) r(b), (VALUES {_ACC}) a(m, s) WHERE length(nfc_normalize(chr(b::INT) || chr(m))) = 1),
r9 AS (SELECT doc_id, t, {strip_envs} AS p FROM {source} WHERE t IS NOT NULL),
r9o AS (SELECT doc_id, t, p, regexp_replace(p, '\\begin\{{(?:{envs})\}}(?:\[[^\]]*\])?', {q(normalize.OPEN_MARK)}, 'g') AS o FROM r9),
r9c AS (SELECT doc_id, regexp_replace(o, '\\end\{{(?:{envs})\}}', '', 'g') AS s,
    (length(p) - length(replace(p, {q(normalize.ENVIRONMENT_MARK)}, ''))) // {len(normalize.ENVIRONMENT_MARK)} + (o <> p)::INT + regexp_matches(o, '\\end\{{(?:{envs})\}}')::INT AS n FROM r9o),
g AS (SELECT doc_id, n + len(regexp_extract_all(s, '{_GRAPHIC}')) AS n, regexp_replace(s, '{_GRAPHIC}', '[[FABRICATED: a file that is not there, \1]]', 'g') AS s FROM r9c),
r3 AS (SELECT doc_id, n + len(regexp_extract_all(s, '{_DIAGRAM}')) AS n, string_split_regex(s, '{_DIAGRAM}') AS p, regexp_extract_all(s, '{_DIAGRAM}', 1) AS k, regexp_extract_all(s, '{_DIAGRAM}', 2) AS d FROM g),
r6 AS (SELECT doc_id, n, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(k) THEN '\texttt{{[TODO ' || lower(k[i]) || ': '
    || regexp_replace(trim(regexp_replace(d[i], '[{{}}$&#_^~%\\]', '', 'g')), '[^\x00-\x7f]', '', 'g') || ']}}' ELSE '' END), '') AS s FROM r3),
w AS (SELECT doc_id, n + len(regexp_extract_all(s, '{_BREAK}')) AS n, regexp_extract_all(regexp_replace(regexp_replace(s, '{_BREAK}', '\1', 'g'), '(?s)(\\(?:[a-zA-Z]+\*?|.))', '\1{chr(1)}', 'g'), '{tokens()}') AS x FROM r6),
pieces AS (SELECT doc_id, i, x[i] AS raw, replace(x[i], chr(1), '') AS x FROM w, unnest(range(1, len(x) + 1)) u(i)),
foreign_ AS (SELECT doc_id, i, unnest(regexp_extract_all(x, '(?s).')) AS c, generate_subscripts(regexp_extract_all(x, '(?s).'), 1) AS place FROM pieces WHERE NOT regexp_matches(raw, '^[\\$%{{}}]') AND regexp_matches(x, '[^\x00-\x7f]')),
mapped AS (SELECT doc_id, i, string_agg(coalesce(l, c), '' ORDER BY place) AS x FROM foreign_ LEFT JOIN latex USING (c) GROUP BY ALL),
r1 AS (SELECT doc_id, i, raw, coalesce(mapped.x, pieces.x) AS x, (mapped.x IS NOT NULL)::INT AS n FROM pieces LEFT JOIN mapped USING (doc_id, i)),
r5 AS (SELECT doc_id, i, raw, n, x AS plain, regexp_matches(raw, '^[\\$%{{}}]') AS kept, regexp_replace(x, '([A-Za-z0-9])([_^])([A-Za-z0-9])', '{chr(5)}\1\2\3{chr(6)}', 'g') AS x FROM r1),
held AS (SELECT doc_id, i, raw, plain, kept, n + (contains(x, chr(5)))::INT AS n, replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(x, '\x05(.)_(.)\x06', '\\ensuremath{{\1{chr(3)}\2}}', 'g'), '\x05(.)\^(.)\x06', '\\ensuremath{{\1{chr(4)}\2}}', 'g'),
    '_([a-zA-Z]*\{{)', '{chr(3)}\1', 'g'), '\^([a-zA-Z]*\{{)', '{chr(4)}\1', 'g'), '\^', '\{chr(4)}') AS x FROM r5),
bare AS (SELECT doc_id, i, raw, plain, kept, n, regexp_replace(regexp_replace(x, '&([a-zA-Z]*\{{)', '{chr(14)}\1', 'g'), '#([a-zA-Z]*\{{)', '{chr(15)}\1', 'g') AS x FROM held),
mended AS (SELECT doc_id, i, CASE WHEN NOT kept THEN n + regexp_matches(x, '[_^&#]')::INT WHEN regexp_matches(raw, '^\\(?:{_ONLY})\*?\x01') THEN 1 ELSE 0 END AS n,
    CASE WHEN NOT kept THEN translate(regexp_replace(x, '([_^&#])', '\\\1', 'g'), '{chr(3)}{chr(4)}{chr(14)}{chr(15)}', '_^&#')
    WHEN regexp_matches(raw, '^\\(?:{_ONLY})\*?\x01') THEN '\ensuremath{{' || plain || '}}' ELSE plain END AS x FROM bare),
parts AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS s, sum(n) AS n FROM mended GROUP BY doc_id),
walked AS (SELECT doc_id, coalesce(parts.s, '') AS s, w.n + coalesce(parts.n, 0) AS n FROM w LEFT JOIN parts USING (doc_id))"""
