"""Scores and selections over candidates, documents and chunks of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dates, fixed, intent, text, titles, urls


def authority(query: Column, url: Column, named: Column) -> Column:
    """The project's bonus where there is one, else that of the site."""
    scope = project_scope(query, url)
    return F.when(scope != 0, scope).otherwise(site_authority(query, url, named))


def site_authority(query: Column, url: Column, named: Column) -> Column:
    """Bonus of a page's site: a public authority of the named place, the named source, or an institution.

    ``named``: host of the source that the query names, or null."""
    h = urls.host(url)
    tokens = text.tokens(query)
    path_terms = F.filter(tokens, lambda t: (F.octet_length(t) >= 3) & ~t.isin(fixed.PATH_STOP) & F.contains(F.lower(urls.path(url)), t))
    by_name = F.when(intent.has_quoted_diagnostic(query) & ~intent.strict_source(query), 0.04).otherwise(0.12) + F.when(F.size(path_terms) >= 2, 0.05).otherwise(0.0)
    institution = F.when(urls.is_institutional(h) | (intent.research(query) & urls.is_scholarly_record(url)), 0.04).otherwise(0.0)
    source = F.when(F.coalesce(urls.belongs(h, named), F.lit(False)), by_name).otherwise(institution)
    place = h.endswith(".gov") & text.has_any(tokens, fixed.PUBLIC_INFORMATION) & F.arrays_overlap(F.split(h, "[.]"), F.filter(tokens, lambda t: F.octet_length(t) >= 4))
    return F.greatest(F.when(F.coalesce(place, F.lit(False)), 0.12).otherwise(0.0), source)


def project_scope(query: Column, url: Column) -> Column:
    """Bonus of the project that a query names: its repository, package or site; a malus for another package's pages."""
    h, terms = urls.host(url), text.identity_terms(query)
    segments = F.split(F.regexp_replace(urls.path(url), "^/", ""), "/")
    asks = intent.source(query)
    repository = (h == "github.com") & F.coalesce(text.identity_matches(F.get(segments, 1), terms), F.lit(False))
    exact = intent.exact_identifier(query).isNotNull() & ~F.lower(F.get(segments, 1)).isin(fixed.LANGUAGE_REPOSITORIES)
    package = F.when(h == "docs.rs", F.when(F.get(segments, 0) == "crate", F.get(segments, 1)).otherwise(F.get(segments, 0))).otherwise(F.when(F.get(segments, 0) == "crates", F.get(segments, 1)))
    other = F.when(package.isNull() | (package == ""), 0.0).when(text.identity_matches(package, terms), 0.12).otherwise(-0.18)
    label = F.when(F.coalesce(text.identity_matches(F.get(F.split(h, "[.]"), 0), terms), F.lit(False)), 0.10).otherwise(0.0)
    return F.when(repository & asks, 0.10).when(repository & exact, 0.08).when(~asks, 0.0).when(h.isin("docs.rs", "crates.io", "lib.rs"), other).otherwise(label)


def candidate_score(query: Column, newest: Column) -> Column:
    """Sum of all signals of a candidate (columns dense, url, title, snippet, date, evidence, recommendation, named)."""
    passage = F.concat_ws("\n", "title", "snippet")
    path = urls.path(F.col("url"))
    wanted_day = dates.query_date_key(query)
    period = F.when(wanted_day.isNull() & ~intent.as_of(query), dates.period_adjustment(dates.month_key(query), dates.hit_month_key(F.col("title"), F.col("snippet"), F.col("date"), path))).otherwise(0.0)
    exact = F.when(F.coalesce(titles.equivalent(titles.requested(query), F.col("title")), F.lit(False)), fixed.EXACT_TITLE_BONUS).otherwise(0.0)
    timeline = text.has_any(text.tokens(query), ["timeline", "history"])
    return (
        F.col("dense")
        + authority(query, F.col("url"), F.col("named"))
        + F.when(intent.recency(query), dates.staleness(newest, dates.hit_date_key(F.col("date"), path))).otherwise(0.0)
        + dates.date_adjustment(wanted_day, dates.hit_date_key(F.col("date"), path))
        + period
        + exact
        + fixed.EVIDENCE_WEIGHT * F.col("evidence")
        + fixed.RECOMMENDATION_WEIGHT * F.col("recommendation")
        + dates.year_adjustment(text.years(passage), F.get(text.years(query), 0), intent.as_of(query), timeline)
        + titles.case_study_adjustment(query, F.col("title"))
    )


def shortlist(df: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` candidates of each query (query_id, pos, score, source_priority, upstream_consensus).

    First the best priority row; then rows with consensus within 0.10 of the best score, among the first half of
    the upstream positions that are left; then by score.  ``selected`` numbers the choice."""
    q = Window.partitionBy("query_id")
    by_score = q.orderBy(F.desc("score"), "pos")
    out = df.withColumn("__best", F.max("score").over(q)).withColumn("__rank", F.row_number().over(by_score))
    first = F.row_number().over(q.orderBy(F.desc("source_priority"), F.desc("score"), "pos"))
    out = out.withColumn("__first", F.col("source_priority") & (first == 1))
    taken = F.max(F.col("__first").cast("int")).over(q)
    quota = F.ceil((F.lit(limit) - taken) / 2)
    agreed = F.col("upstream_consensus") & (F.col("pos") < quota) & (F.col("__best") - F.col("score") <= fixed.GAP) & ~F.col("__first")
    out = out.withColumn("__rule", F.when(F.col("__first"), 0).when(agreed, 1).otherwise(2))
    order = q.orderBy("__rule", F.when(F.col("__rule") == 1, F.col("pos")).otherwise(F.col("__rank")))
    return out.withColumn("selected", F.row_number().over(order) - 1).where(F.col("selected") < limit).drop("__best", "__rank", "__first", "__rule")


def best_chunks(scored: DataFrame, per_document: int = fixed.CHUNKS_PER_DOCUMENT, total: int = fixed.CHUNKS_TOTAL) -> DataFrame:
    """The best chunk of every document first, then others by score: ``per_document`` of each, ``total`` of a query."""
    q = Window.partitionBy("query_id")
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal"))
    ranked = scored.withColumn("__own", own).where(F.col("__own") <= per_document)
    order = F.row_number().over(q.orderBy((F.col("__own") > 1).cast("int"), F.desc("score"), "doc_id", "ordinal"))
    return ranked.withColumn("selected", order - 1).where(F.col("selected") < total).drop("__own")


def topped_up(scored: DataFrame) -> DataFrame:
    """The best chunk of each document gains what its search excerpt and the document's consensus have over it.

    ``scored``: query_id, doc_id, ordinal, score, excerpt_score, consensus, document_consensus."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal")
    gain = fixed.GAP * F.greatest(F.lit(0.0), F.col("excerpt_score") - F.col("score")) + F.greatest(F.lit(0.0), F.col("document_consensus") - F.col("consensus"))
    return scored.withColumn("score", F.when(F.row_number().over(w) == 1, F.col("score") + gain).otherwise(F.col("score")))


def anchor(df: DataFrame) -> DataFrame:
    """The row that anchors a query's evidence: of the required class, within 0.10 of the best, most evidence last."""
    q = Window.partitionBy("query_id")
    near = df.where("in_class").withColumn("__best", F.max("score").over(q)).where(F.col("__best") - F.col("score") <= fixed.GAP)
    return near.withColumn("__r", F.row_number().over(q.orderBy(F.desc("score"), F.desc("evidence"), "pos"))).where("__r = 1").drop("__best", "__r")


def useful_excerpt(excerpt: Column, content: Column, stronger: Column) -> Column:
    """The excerpt as a paragraph of its own, where it adds something to the content; else null."""
    flat = lambda x: text.ascii_lower(text.collapse(x))
    return F.when((text.strip(excerpt) != "") & ~F.contains(flat(content), flat(excerpt)) & stronger, F.concat(F.lit("Search excerpt: "), excerpt))


def documents(scored: DataFrame, limit: int) -> DataFrame:
    """Documents of each query: the priority one, the anchor, half by upstream consensus, the rest by score; diversified.

    ``scored``: query_id, pos, score, source_priority, upstream_consensus, exact, is_anchor, source, subject.
    Reservations and the swaps that follow are sequential over a query's few documents: one Arrow group each."""
    import pandas as pd

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in scored.schema.fields)}, selected int"

    def conflict(a, b) -> bool:
        if a.source is None or a.source != b.source:
            return False
        x, y = set(a.subject), set(b.subject)
        return len(x & y) >= fixed.DIVERSITY_TERMS and 100 * len(x & y) >= fixed.DIVERSITY_PERCENT * min(len(x), len(y))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = list(rows.sort_values("pos").itertuples(index=False))
        exact = any(x.exact for x in r)
        rank = sorted(range(len(r)), key=lambda i: ((not r[i].exact) if exact else 0, -r[i].score, r[i].pos))
        best = max(x.score for x in r if x.exact or not exact)
        chosen = [i for i in rank if r[i].source_priority][:1]
        chosen += [i for i in rank if r[i].is_anchor and i not in chosen][:1]
        for i in range(min(len(r), -(-(limit - len(chosen)) // 2))):
            if r[i].upstream_consensus and best - r[i].score <= fixed.GAP and i not in chosen and len(chosen) < limit:
                chosen.append(i)
        chosen = (chosen + [i for i in rank if i not in chosen])[:limit]
        key = lambda i: (not r[i].source_priority, not r[i].exact, not r[i].is_anchor, r[i].pos)
        chosen.sort(key=key)
        for at, i in enumerate(chosen):
            if r[i].source_priority or r[i].exact or r[i].is_anchor or not any(conflict(r[i], r[j]) for j in chosen[:at]):
                continue
            others = [j for j in chosen if j != i]
            for k in rank:
                if k not in chosen and r[i].score - r[k].score <= fixed.DIVERSITY_GAP and not any(conflict(r[k], r[j]) for j in others):
                    chosen[at] = k
                    break
        chosen.sort(key=key)
        out = rows.sort_values("pos").iloc[chosen].copy()
        out["selected"] = range(len(out))
        return out

    return scored.groupBy("query_id").applyInPandas(run, schema)


def adjacent_chunks(scored: DataFrame, per_document: int = fixed.CHUNKS_PER_DOCUMENT, total: int = fixed.CHUNKS_TOTAL) -> DataFrame:
    """Chunk choice where documents may hold a wanted name (``seed``): those take only neighbouring chunks.

    ``scored``: query_id, doc_id, ordinal, score, seed.  Rows that the choice cannot reach are cut before it, so that a
    query's group has ``total`` documents at most and of each the best chunks, or those near its seed."""
    import pandas as pd

    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("seed"), F.desc("score"), "ordinal")
    head = F.first(F.struct("score", "ordinal", "seed")).over(w)
    near = F.when(F.col("__head.seed"), F.abs(F.col("ordinal") - F.col("__head.ordinal")) < per_document).otherwise(F.col("__place") <= per_document)
    reached = scored.withColumn("__head", head).withColumn("__place", F.row_number().over(w)).where(near).withColumn("__score", F.col("__head.score"))
    heads = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("__score"), "doc_id"))
    scored = reached.withColumn("__heads", heads).where(F.col("__heads") <= total).select(*scored.columns)

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in scored.schema.fields)}, selected int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = list(rows.sort_values(["score", "doc_id", "ordinal"], ascending=[False, True, True]).itertuples(index=False))
        heads = {}
        for i, x in enumerate(r):
            if x.doc_id not in heads or x.seed and not r[heads[x.doc_id]].seed:
                heads[x.doc_id] = i
        chosen = sorted(heads.values(), key=lambda i: (-r[i].score, r[i].doc_id))[:total]
        held = {}
        for i in chosen:
            held.setdefault(r[i].doc_id, []).append(i)
        near = lambda i, d: any(abs(r[i].ordinal - r[j].ordinal) == 1 for j in held[d])
        coherent = [r[i].doc_id for i in chosen if r[i].seed]
        for d in coherent:
            while len(held[d]) < per_document and len(chosen) < total:
                options = [i for i, x in enumerate(r) if x.doc_id == d and i not in held[d] and near(i, d)]
                if not options:
                    break
                i = min(options, key=lambda i: (not r[i].seed, -r[i].score, r[i].ordinal))
                held[d].append(i)
                chosen.append(i)
        for i, x in enumerate(r):
            d = x.doc_id
            if d in held and i not in held[d] and len(chosen) < total and len(held[d]) < per_document and (d not in coherent or near(i, d)):
                held[d].append(i)
                chosen.append(i)
        out = pd.DataFrame([r[i]._asdict() for i in chosen], columns=rows.columns)
        out["selected"] = range(len(out))
        return out

    return scored.groupBy("query_id").applyInPandas(run, schema)


def infer_official_host(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, host, score): the likely official site among each query's first twelve results; no row where none is credible.

    ``queries``: query_id, query; ``results``: query_id, pos (from 0), url, title, engines (an array)."""
    words = F.transform(F.split("query", r"[^\p{L}\p{N}]+"), text.ascii_lower)
    public = text.has_any(words, ["election", "voter", "voting"]) & text.has_any(words, ["deadline", "registration"])
    q = queries.select("query_id", text.distinctive_tokens(F.col("query")).alias("tokens"), public.alias("public"))
    q = q.withColumn("brands", F.transform("tokens", text.brand))
    r = results.where(F.col("pos") < 12).withColumn("url", urls.parse(F.col("url"))).withColumn("host", F.regexp_replace(urls.host(F.col("url")), r"^www\.", ""))
    r = r.where(F.col("host").isNotNull() & ~urls.is_generic(F.col("host"))).join(q, "query_id")
    h, title = F.col("host"), text.ascii_lower(F.coalesce("title", F.lit("")))
    labels = F.transform(F.split(h, "[.]"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))
    brand = F.arrays_overlap(labels, "brands")
    docs = h.startswith("doc.") | h.startswith("docs.") | (h == "docs.rs") | h.endswith(".readthedocs.io")
    identity = docs & F.arrays_overlap(F.transform(F.split(urls.path(F.col("url")), "/"), text.brand), "brands")
    matches = F.least(F.lit(2), F.size(F.filter("tokens", lambda t: F.contains(title, t))))
    r = r.select("query_id", "pos", "host", "public", *(c.alias(n) for c, n in ((brand, "brand"), (identity, "identity"), (urls.is_institutional(h), "institution"), (matches, "matches"))), F.least(F.lit(2), F.coalesce(F.size("engines"), F.lit(0))).alias("n"))
    credible = F.when(F.col("public"), h.endswith(".gov") & (F.col("matches") >= 1)).otherwise(((F.col("brand") | F.col("identity")) & (F.col("matches") >= 1)) | (F.col("institution") & (F.col("matches") >= 2)))
    score = 4 * F.col("brand").cast("int") + 3 * F.col("identity").cast("int") + 2 * F.col("institution").cast("int") + F.col("matches") + F.greatest(F.lit(0), F.col("n"))
    best = F.max_by(F.struct("host", "score"), F.struct("score", -F.col("pos")))
    return r.withColumn("score", score).where(credible).groupBy("query_id").agg(best.alias("best")).select("query_id", urls.search_host(F.col("best.host")).alias("host"), F.col("best.score").alias("score"))
