"""Reports of finished runs: Markdown to HTML, prompt assembly, row badges and pills. Small results, on the driver."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom.operators import roadmap

# LaTeX commands that replies contain, as characters; wrappers of text; the longest span between single dollars.
LATEX = {
    r"\rightarrow": "→", r"\Rightarrow": "⇒", r"\longrightarrow": "→", r"\leftarrow": "←", r"\Leftarrow": "⇐", r"\leftrightarrow": "↔", r"\to": "→", r"\gets": "←",
    r"\times": "×", r"\cdot": "·", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\approx": "≈", r"\neq": "≠", r"\equiv": "≡", r"\leq": "≤", r"\geq": "≥", r"\le": "≤", r"\ge": "≥",
    r"\ll": "≪", r"\gg": "≫", r"\sim": "~", r"\propto": "∝", r"\infty": "∞", r"\sum": "∑", r"\prod": "∏", r"\sqrt": "√", r"\Delta": "Δ", r"\Sigma": "Σ", r"\Omega": "Ω",
    r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\epsilon": "ε", r"\theta": "θ", r"\lambda": "λ", r"\mu": "μ", r"\pi": "π", r"\rho": "ρ", r"\sigma": "σ", r"\tau": "τ", r"\phi": "φ",
    r"\%": "%", r"\&": "&", r"\#": "#", r"\_": "_", r"\$": "$",
}
WRAPPERS, LONGEST_FORMULA = ["text", "mathrm", "mathbf", "mathit", "mathsf", "operatorname"], 80

#: What a text is scanned for: formulas in one of four kinds of brackets, and commands outside of any. And what a formula is: wrapped text, commands, braces.
_SCAN = re.compile(rf"\$\$(?P<block>.+?)\$\$|\\\[(?P<display>.+?)\\\]|\\\((?P<inline>.+?)\\\)|\$(?P<money>[^$\n]{{1,{LONGEST_FORMULA}}})\$|(?P<bare>\\(?:[a-zA-Z]+|[%&#_$]))", re.DOTALL)
_PARTS = re.compile(rf"\\(?:{'|'.join(WRAPPERS)})\s*\{{(?P<words>[^{{}}]*)\}}|(?P<command>\\(?:[a-zA-Z]+|[%&#_$]))|(?P<brace>[{{}}])")
_ITEM = re.compile(r"(?P<indent>\s*)(?:(?P<dot>[-*+])|\d+[.)])\s+(?P<text>.*)")


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    out = re.sub(r"`([^`]+)`", r"<code>\1</code>", out)
    out = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"(?<![*\w])\*([^*\s][^*]*)\*(?!\w)", r"<em>\1</em>", out)
    return re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2" rel="nofollow noopener">\1</a>', out)


def _part(m: re.Match[str]) -> str:
    """A part of a formula in characters; commands without one and braces go."""
    return _PARTS.sub(_part, m["words"]) if m.lastgroup == "words" else LATEX.get(m["command"] or "", "")


def _found(m: re.Match[str]) -> str:
    """A formula in one line, or a lone command; sums of money between dollars stay as they are."""
    inner = m[m.lastgroup]
    if m.lastgroup == "bare":
        return LATEX.get(inner, inner)
    if m.lastgroup == "money" and not re.search(r"[\\=<>^]|_\{", inner):
        return m[0]
    return " ".join(_PARTS.sub(_part, inner).split())


def plain_math(text: str) -> str:
    """Formulas and commands as Unicode text, in one scan."""
    return _SCAN.sub(_found, text)


def _lists(items: list[tuple[int, str, str]]) -> list[str]:
    """Items (indent, ul or ol, text) as nested lists: what is indented more than an item is inside it; another kind, or less of an indent, begins a list of its own."""
    out, k = [], 0
    while k < len(items):
        indent, kind, _ = items[k]
        rows = []
        while k < len(items) and items[k][:2] == (indent, kind):
            end = next((j for j in range(k + 1, len(items)) if items[j][0] <= indent), len(items))
            rows.append(f"<li>{_inline(items[k][2])}{''.join(_lists(items[k + 1 : end]))}</li>")
            k = end
        out.append(f"<{kind}>{''.join(rows)}</{kind}>")
    return out


def markdown_to_html(text: str | None) -> str:
    """Headings, nested lists (blank lines between their items are nothing), rules, and paragraphs whose line ends are kept; everything else is escaped text."""
    out: list[str] = []
    items: list[tuple[int, str, str]] = []
    lines: list[str] = []

    def close(*kept: list) -> None:
        if items and items is not (kept[0] if kept else None):
            out.extend(_lists(items))
            items.clear()
        if lines and lines is not (kept[0] if kept else None):
            out.append("<p>" + "<br>".join(map(_inline, lines)) + "</p>")
            lines.clear()

    for raw in plain_math(text or "").splitlines():
        line = raw.strip()
        if not line:
            close(items)  # the list may go on behind it
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif re.fullmatch(r"(-{3,}|\*{3,})", line):
            close()
            out.append("<hr>")
        elif m := _ITEM.match(raw):
            close(items)
            items.append((len(m["indent"].expandtabs(4)), "ul" if m["dot"] else "ol", m["text"].strip()))
        else:
            close(lines)
            lines.append(line)
    close()
    return "\n".join(out)


def narrative_prompt(correlations: DataFrame, actions: DataFrame, run: str = "run_id", significant: int = 15, steps: int = 10) -> DataFrame:
    """run, prompt: the strongest significant factors and the first actions, one line each."""
    line = F.concat(F.lit("- "), F.col("factor_id"), F.lit(": r="), F.format_number("best", 2), F.lit(", n="), F.col("n"))
    top = correlations.filter("significant").withColumn("__p", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(F.abs("best")), "factor_id"))).filter(F.col("__p") <= significant)
    a = top.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", line.alias("l")))), lambda x: x["l"]), "\n").alias("factors"))
    step = F.concat(F.lit("- "), F.col("name"), F.lit(": from "), F.coalesce(F.format_number("current", 1), F.lit("-")), F.lit(" to "), F.format_number("goal", 1))
    b = actions.filter(F.col("place") <= steps).groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", step.alias("l")))), lambda x: x["l"]), "\n").alias("steps"))
    none = F.lit("none")
    return a.join(b, run, "full_outer").select(run, F.concat(F.lit("Significant factors:\n"), F.coalesce("factors", none), F.lit("\n\nActions:\n"), F.coalesce("steps", none)).alias("prompt"))


def phased(actions: DataFrame, definitions: DataFrame, run: str = "run_id") -> DataFrame:
    """Actions in the order of phases, by score within a phase."""
    d = definitions.select("factor_id", "phase_order")
    return actions.join(d, "factor_id", "left").withColumn("row", F.row_number().over(Window.partitionBy(run).orderBy(F.col("phase_order").asc_nulls_last(), F.desc("score"), "factor_id")))


def badges(scored: DataFrame) -> DataFrame:
    return scored.withColumn("badge", roadmap.status(F.col("current"), F.col("goal"), F.coalesce(F.col("registered") == "less_is_better", F.lit(False))))


def pills(eav: DataFrame, run: str = "run_id") -> DataFrame:
    """run, attribute, rows, misses, place: by rows, then misses, then name."""
    g = eav.groupBy(run, "attribute").agg(F.count("*").alias("rows"), F.count_if(F.col("gap") != "").alias("misses"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("rows"), F.desc("misses"), "attribute")))


def shown_rows(rows: DataFrame, group: str | None = None, hide_met: bool = False) -> DataFrame:
    """The report's filters."""
    out = rows if group is None else rows.filter(F.col("group") == group)
    return out.filter(F.col("badge") != "met") if hide_met else out


def compare_prompts(requests: DataFrame, moved: DataFrame, changed: DataFrame, most: int = 8) -> DataFrame:
    """run_id, prompt: what moved between two result lists, for a narrative. requests: run_id, keyword, update_name, before_date, after_date, the last three nullable; moved and changed: ``compare``'s moves and churn.

    The first ``most`` of those who rose or came and of those who fell or went, the largest change first; the giants only as two numbers. authority_score and traffic_trend_pct are told where moves carry them.
    """
    n = lambda c: F.col(c).cast("string")
    step = F.when(F.col("status") == "entered", F.concat(F.lit("new at "), n("after_rank"))).when(F.col("status") == "dropped", F.concat(F.lit("gone from "), n("before_rank"))).otherwise(F.concat(F.lit("from "), n("before_rank"), F.lit(" to "), n("after_rank")))
    soft = {"authority_score": "authority %.0f", "traffic_trend_pct": "traffic %+.0f percent"}
    told = [F.when(F.col(c).isNotNull(), F.format_string(say, F.col(c).cast("double"))) for c, say in soft.items() if c in moved.columns]
    line = F.concat_ws(", ", F.concat(F.lit("- "), F.col("domain"), F.lit(" "), step), *told)
    side = F.when(F.col("status").isin("entered", "up"), "rose").when(F.col("status").isin("down", "dropped"), "fell")
    order = Window.partitionBy("run_id", "side").orderBy(F.desc(F.coalesce(F.abs("delta"), F.lit(999))), F.coalesce("after_rank", "before_rank"), "domain")
    first = moved.withColumn("side", side).filter("side is not null and not is_mega").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    lists = first.groupBy("run_id").pivot("side", ["rose", "fell"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n"))
    ask = "Explain what this search's result list shows, in four parts under ## headings: what changed; whether known sites or better answers gained, by the lines below; what a site should do; what this can't show. Use these numbers only."
    held = F.when(F.col("n1_flip"), F.concat(F.lit("First place: from "), "n1_before", F.lit(" to "), "n1_after")).otherwise(F.concat(F.lit("First place held: "), F.coalesce("n1_after", "n1_before", F.lit("none"))))
    none = F.lit("- none")
    j = changed.join(requests.select("run_id", "keyword", "update_name", "before_date", "after_date"), "run_id").join(lists, "run_id", "left")
    parts = [
        F.lit(ask), F.concat(F.lit("Search: "), "keyword"), F.concat(F.lit("Update: "), F.coalesce("update_name", F.lit("not named"))),
        F.concat(F.lit("Between: "), F.coalesce(n("before_date"), F.lit("?")), F.lit(" and "), F.coalesce(n("after_date"), F.lit("?"))), F.format_string("New on the list: %.0f percent", F.coalesce("churn_pct", F.lit(0.0))), held,
        F.concat(F.lit("Rose:\n"), F.coalesce("rose", none)), F.concat(F.lit("Fell:\n"), F.coalesce("fell", none)), F.format_string("Large platforms: %d came, %d went", "mega_entered", "mega_dropped"),
    ]
    return j.select("run_id", F.concat_ws("\n", *parts).alias("prompt"))


#: Sections of a run's page: a title, the result that it shows, its columns, and the order of its rows.
SECTIONS = [
    ("Verdict", "overall", ["overall", "summary"], []),
    ("Gates", "gate_report", ["name", "score", "verdict", "tier", "weight", "details"], ["ord"]),
    ("Format of the results", "intent_panel", ["dominant", "share", "target_type", "fit", "note"], []),
    ("Who ranks above, and why", "cards", ["rank", "domain", "url", "reason", "evidence"], ["rank", "place"]),
    ("Actions", "actions", ["place", "name", "phase", "difficulty", "current", "goal"], ["place"]),
    ("Factors that go with rank", "correlations", ["factor_id", "best", "n", "significant"], []),
    ("Entities to add", "entities_must_add", ["name", "consensus"], ["add_place"]),
    ("Facts and gaps", "entities_eav", ["canon", "attribute", "consensus", "consensus_value", "target_value", "gap"], []),
    ("Sub-intents nobody answers", "meaning_gaps", ["name", "best"], ["best"]),
    ("Search volume of brands", "brand_leaderboard", ["domain", "volume"], []),
]


def _cell(v: object) -> str:
    text = "" if v is None else f"{v:.2f}".rstrip("0").rstrip(".") if isinstance(v, float) else "; ".join(map(str, v)) if isinstance(v, list) else str(v)
    return f"<td>{html.escape(text)}</td>"


def run_page(out: dict[str, DataFrame], run_id: object, title: str, most: int = 200) -> str:
    """The HTML page of one run out of ``analyze``'s results: a section for each of them that there is, ``most`` rows at most, and it says where there are more. The brief comes last, as text."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    of = lambda name: out[name].filter(F.col("run_id") == F.lit(run_id))
    for head, name, columns, order in SECTIONS:
        if name not in out:
            continue
        there = [c for c in columns if c in out[name].columns]
        rows = of(name).orderBy(*order) if order else of(name)
        got = rows.select(*there).limit(most + 1).collect()
        if got:
            body = "".join(f"<tr>{''.join(map(_cell, r))}</tr>" for r in got[:most])
            more = f"<p>The first {most} rows.</p>" if len(got) > most else ""
            parts.append(f"<h2>{html.escape(head)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in there)}</tr>{body}</table>{more}")
    if "brief_texts" in out and (brief := of("brief_texts").select("markdown").first()):
        parts.append(markdown_to_html(brief["markdown"]))
    return "\n".join(parts)
