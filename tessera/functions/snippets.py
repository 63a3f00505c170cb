"""Pieces of source lines, requirements, versions, citations and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may open a line comment, in the order of looking; debt words; starts of merge markers.
PREFIXES = ["//", "#", "--", ";"]
DEBT = r"\b(TODO|FIXME|HACK|XXX)\b"
MERGE_MARKS = ["<<<<<<< ", "=======", ">>>>>>> "]
LITERAL = r"([\"'`])(?:\\.|(?!\1).)*\1"
#: Words that make a name a measure, words that do beside "rate", words of thresholds, and those that do by themselves.
MEASURES = (
    "accuracy acc precision recall f1 fbeta auc auroc auprc ndcg mrr map correctness faithfulness groundedness grounding relevance helpfulness coherence fluency toxicity calibration brier rmse mse mae mape perplexity bleu rouge meteor"
    " bertscore score quality metric judge grade composite rating eval benchmark kappa agreement regret mean average avg median delta lift uplift pvalue baseline"
).split()
RATE_PARTNERS = "win pass hit success error failure fail accept reject click conversion completion refusal abandon match correct".split()
THRESHOLDS, BARE_THRESHOLDS = "threshold cutoff min max target budget slo sla gate tolerance floor ceiling limit bar".split(), "threshold cutoff slo sla gate bar".split()
#: Comparisons of a name with a number, either way round, and the mirrored operators.
NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
NUMBER_END, OPERATOR = r"[fFdDlLuU]?(?![\w.])", r"(>=|<=|==|!=|>|<)"
COMPARED = rf"([A-Za-z_][\w.]*)(?:\([^()]*\))?\s*{OPERATOR}\s*({NUMBER}){NUMBER_END}"
MIRRORED = rf"(?<![\w.])({NUMBER}){NUMBER_END}\s*{OPERATOR}\s*([A-Za-z_][\w.]*)"
MIRROR = {">=": "<=", "<=": ">=", ">": "<", "<": ">", "==": "==", "!=": "!="}
#: Releases that still get fixes and those that don't (all but these two lists: unknown).
SUPPORTED, ENDED = [(5, 2), (6, 0), (6, 1)], [(4, 0), (4, 1), (4, 2), (5, 0), (5, 1)]
#: Placeholders.
PLACEHOLDERS = r"(your[_\-]api[_\-]key|api[_\-]key[_\-]here|insert_.+_here|replace_me|replaceme|changeme|change_me|<your)"
#: Fenced blocks, traces in them, paths in running text and their suffixes, suggestions.
FENCE, SUGGESTION = r"(?s)```([\w+-]*)\r?\n(.*?)```", r"(?s)```suggestion\r?\n(.*?)```"
MENTIONED = r"(?<![\w/.-])((?:[\w.-]+/){1,6}[\w.-]+\.[A-Za-z]\w{0,4})(?![\w/])"
CODE_SUFFIXES = "py pyi go rs js jsx ts tsx rb java kt kts c h cc cpp hpp cs php swift scala sh bash sql yml yaml toml json cfg ini tf proto vue svelte".split()
#: Citations in Markdown, and what isn't one.
CITED = r"`([^`\n]+?)`|\]\(([^)\s]+)\)|(?<![\w/.-])((?:[\w.-]+/)+[\w.-]+\.[A-Za-z]\w{0,4})(?::\d+)?(?![\w/])"
URL, LINE_SUFFIX = r"(?i)^([a-z][a-z0-9+.-]*://|www\.|#|mailto:)", r"^(.*?):(\d+)(?:-\d+)?$"
#: Names of deployed models, and the tail that tells one from a family's name.
MODEL, MODEL_TAIL = r"""(?i)['"]((?:claude|gpt|o[134]|gemini|llama|mistral|mixtral|deepseek|qwen|command-r|sonar|grok|phi|gemma)[a-z0-9._-]*(?:-[a-z0-9._]+)*)['"]""", r"(?i)[-.][0-9a-z]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_literals(line: Column) -> Column:
    """String literals with their insides blanked; lengths stay."""
    pieces = F.regexp_extract_all(line, F.lit(LITERAL + "|[^\"'`]+|[\"'`]"), F.lit(0))
    whole = lambda x: (F.length(x) > 1) & F.left(x, F.lit(1)).isin('"', "'", "`")
    return F.array_join(F.transform(pieces, lambda x: F.when(whole(x), F.concat(F.left(x, F.lit(1)), F.repeat(F.lit(" "), F.length(x) - 2), F.right(x, F.lit(1)))).otherwise(x)), "")


def comment_body(line: Column) -> Column:
    """What follows the first prefix, in the prefixes' order, that stands outside literals; null without one."""

    def after(blanked: Column) -> Column:
        made = None
        for p in PREFIXES:
            at = F.instr(blanked, p)
            found = strip(F.substring(line, at + len(p), F.length(line)))
            made = F.when(at > 0, found) if made is None else made.when(at > 0, found)
        return made

    return let(blank_literals(line), after)


def is_metric(tokens: Column) -> Column:
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return has(MEASURES) | (F.array_contains(tokens, "rate") & has(RATE_PARTNERS))


def is_threshold(tokens: Column) -> Column:
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return has(THRESHOLDS) & (has(MEASURES) | has(BARE_THRESHOLDS))


def comparisons(line: Column) -> Column:
    """``array<struct<name, operator, number>>``: names compared with numbers, those written the other way round turned; each once."""
    part = lambda pattern, k: F.regexp_extract_all(line, F.lit(pattern), F.lit(k))
    turned = F.create_map(*(F.lit(x) for pair in MIRROR.items() for x in pair))
    leaf = lambda name: F.substring_index(name, ".", -1)
    row = lambda name, op, number: F.struct(leaf(name).alias("name"), op.alias("operator"), number.alias("number"))
    plain = F.transform(F.arrays_zip(part(COMPARED, 1).alias("a"), part(COMPARED, 2).alias("b"), part(COMPARED, 3).alias("c")), lambda x: row(x["a"], x["b"], x["c"]))
    other = F.transform(F.arrays_zip(part(MIRRORED, 3).alias("a"), part(MIRRORED, 2).alias("b"), part(MIRRORED, 1).alias("c")), lambda x: row(x["a"], F.element_at(turned, x["b"]), x["c"]))
    return F.array_distinct(F.concat(plain, other))


def requirement_head(spec: Column) -> Column:
    """The distribution at a requirement's head, lower-cased; '' for flags and blanks."""
    bare = strip(spec)
    return F.when((bare == "") | bare.startswith("-"), "").otherwise(F.lower(strip(F.regexp_extract(bare, r"^[^\[<>=!~;, \t]*", 0))))


def distribution(spec: Column) -> Column:
    """A requirement's bare name for comparing: without extras, conditions and versions, lower case, '_' for '-' and '.'."""
    bare = F.regexp_replace(strip(spec), r"\[.*?\]", "")
    return F.translate(F.lower(strip(F.regexp_extract(bare, r"^[^\s><=!~\[;@]*", 0))), "-.", "__")


def version(text: Column) -> Column:
    """``struct<major, minor>``: the first number of a requirement with a major from 1 to 20; null without one."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9.]+)"), F.lit(1)), lambda x: F.filter(F.split(x, r"\."), lambda p: p != ""))
    usable = F.filter(tokens, lambda p: (F.size(p) > 0) & (F.get(p, F.lit(0)).try_cast("int").between(1, 20)))
    return let(F.get(usable, F.lit(0)), lambda p: F.when(p.isNotNull(), F.struct(F.get(p, F.lit(0)).cast("int").alias("major"), F.coalesce(F.get(p, F.lit(1)).try_cast("int"), F.lit(0)).alias("minor"))))


def is_ended(v: Column) -> Column:
    """Whether a release gets no more fixes; unknown later ones do."""
    known = lambda rows: v.isin(*[F.struct(F.lit(a).alias("major"), F.lit(b).alias("minor")) for a, b in rows])
    oldest = min(SUPPORTED + ENDED)
    return F.coalesce(known(ENDED) | (v < F.struct(F.lit(oldest[0]).alias("major"), F.lit(oldest[1]).alias("minor"))), F.lit(False))


def version_severity(v: Column, deprecated: Column, removed: Column, target: Column) -> Column:
    """A change's weight at a version: gone already high, deprecated already medium, gone at the target low, else null."""
    return F.when(removed <= v, "high").when(deprecated <= v, "medium").when(removed <= target, "low")


def satisfies(spec: Column, found: Column) -> Column:
    """Whether a version can satisfy a caret, tilde, exact or x range; what isn't one of these counts as satisfied."""
    shape, exact = r"^([~^]?)(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?$", r"^(\d+)\.(\d+)\.(\d+)"
    rng = strip(F.coalesce(spec, F.lit("")))
    r, v = (lambda k: F.regexp_extract(rng, shape, k)), (lambda k: F.regexp_extract(found, exact, k))
    free = lambda x: x.isin("", "x", "X", "*")
    same = lambda a, b: a.try_cast("int") == b.try_cast("int")
    return (
        F.when(rng.isin("", "*", "latest") | (F.coalesce(found, F.lit("")) == "") | ~rng.rlike(shape) | ~found.rlike(exact), True).when(~same(r(2), v(1)), False)
        .when(r(1) == "^", (r(2).try_cast("int") != 0) | free(r(3)) | same(r(3), v(2))).when(r(1) == "~", free(r(3)) | same(r(3), v(2))).when(free(r(3)), True).when(~same(r(3), v(2)), False).otherwise(free(r(4)) | same(r(4), v(3)))
    )


def is_placeholder(value: Column) -> Column:
    low = F.lower(strip(value))
    return (low == "lorem ipsum") | low.contains("example.com") | low.startswith("lorem ipsum") | low.startswith("<your") | value.rlike("(?i)" + PLACEHOLDERS)


def citations(text: Column) -> Column:
    """``array<struct<path, line>>``: what a page's text claims to point at in the tree, in the order of the text."""
    hits = F.regexp_extract_all(text, F.lit(CITED), F.lit(0))
    raw = F.transform(hits, lambda x: strip(F.when(F.left(x, F.lit(1)) == "`", F.substring(x, F.lit(2), F.length(x) - 2)).when(F.left(x, F.lit(2)) == "](", F.substring(x, F.lit(3), F.length(x) - 3)).otherwise(F.regexp_replace(x, r":\d+$", ""))))
    kept = F.filter(raw, lambda x: (x != "") & ~x.rlike(URL))
    split = F.transform(kept, lambda x: F.when(x.rlike(LINE_SUFFIX), F.struct(F.regexp_extract(x, LINE_SUFFIX, 1).alias("path"), F.regexp_extract(x, LINE_SUFFIX, 2).cast("int").alias("line"))).otherwise(F.struct(x.alias("path"), F.lit(None).cast("int").alias("line"))))
    plausible = lambda x: x["path"].contains("/") & ~x["path"].rlike(r"\s|^[-~/]|[<>{}*$|]")
    return F.transform(F.filter(split, plausible), lambda x: F.struct(F.regexp_replace(x["path"], r"^[./]+", "").alias("path"), x["line"].alias("line")))


def line_ranges(spec: Column) -> Column:
    """``array<struct<low, high>>`` of '1,5-9'; other parts are left out."""
    span = r"^(\d+)[-–—](\d+)$"
    parts = F.filter(F.split(strip(spec), r"[,\s]+"), lambda x: x.rlike(span) | x.rlike(r"^\d+$"))
    number = lambda x, k: F.regexp_extract(x, span, k).cast("int")
    row = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return F.transform(parts, lambda x: F.when(x.rlike(span), row(F.least(number(x, 1), number(x, 2)), F.greatest(number(x, 1), number(x, 2)))).otherwise(row(x.try_cast("int"), x.try_cast("int"))))


def escaped(value: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def in_script(json: Column) -> Column:
    """JSON that may stand in a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def as_glob(path: Column) -> Column:
    """A computed path as a pattern: holes become '*'; null for a path without hole or wildcard."""
    glob = F.regexp_replace(path, r"\{[^{}]*\}|\$\{[^{}]*\}|%[sd]|%\([^)]*\)s", "*")
    return F.when((glob != path) | path.rlike(r"[*?]"), F.regexp_replace(glob, r"\*+", "*"))


def models(text: Column) -> Column:
    """Names of deployed models in quotes."""
    return F.filter(F.regexp_extract_all(text, F.lit(MODEL), F.lit(1)), lambda x: x.rlike(MODEL_TAIL))


def preview(lines: Column, most: int = 3, chars: int = 100) -> Column:
    """The first lines of a snippet, stripped, '...' for the rest, cut to so many characters."""
    head = F.filter(F.transform(F.slice(lines, 1, most), strip), lambda x: x != "")
    return F.left(F.concat(F.array_join(head, "\n"), F.when(F.size(lines) > most, "\n...").otherwise("")), F.lit(chars))


def repository_path(value: Column) -> Column:
    """Forward slashes, no './' and no '/' before it, 'x/..' folded away."""
    from tessera.functions.text import normal_path

    return F.regexp_replace(normal_path(F.replace(strip(value), F.lit("\\"), F.lit("/"))), "^/+", "")
