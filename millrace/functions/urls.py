"""URL functions over plain web URLs, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.text import let, strip, words_of


def parse(x: Column) -> Column:
    """A trimmed http(s) URL without its fragment, else null."""
    y = F.regexp_replace(strip(x), "#.*$", "")
    return F.when(y.rlike("(?i)^https?://[^/?#\\s]+") & F.try_parse_url(y, F.lit("HOST")).isNotNull(), y)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def canonical(url: Column) -> Column:
    """Key of a URL: https, no leading ``www.``, no trailing slashes, no tracking parameters."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    port = F.regexp_extract(url, r"(?i)^https?://[^/?#]*?(:[0-9]+)?(?=[/?#]|$)", 1)
    default = (port == ":443") & F.lower(url).startswith("https") | (port == ":80") & F.lower(url).startswith("http:")
    port = F.when(default, "").otherwise(port)
    p = path(url)
    p = F.when(F.length(p) > 1, F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(p)
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).startswith("utm_") & ~F.lower(F.substring_index(q, "=", 1)).isin(fixed.TRACKING))
    kept = F.transform(kept, lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("="))))
    return F.concat(F.lit("https://"), h, port, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def registrable(h: Column) -> Column:
    labels = F.split(h, "[.]")
    n = F.size(labels)
    suffix = F.array_join(F.slice(labels, -2, 2), ".")
    keep = F.when(suffix.isin(fixed.MULTI_PART_SUFFIXES), 3).otherwise(2)
    return F.when(n <= 2, h).otherwise(F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def search_host(h: Column) -> Column:
    return F.when(h.startswith("doc.") | h.startswith("docs."), h).otherwise(registrable(h))


def belongs(h: Column, authority: Column) -> Column:
    """Equal to an authority's host, or below it."""
    return (h == authority) | h.endswith(F.concat(F.lit("."), authority))


def is_generic(h: Column) -> Column:
    return F.exists(words_of(fixed.GENERIC_HOSTS), lambda g: belongs(h, g))


def is_scholarly_record(url: Column) -> Column:
    h = host(url)
    return (h == "arxiv.org") | h.endswith(".arxiv.org") | h.isin("doi.org", "dx.doi.org") | path(url).contains("/doi/")


def is_scholarly_manifestation(url: Column) -> Column:
    h = host(url)
    known = F.exists(words_of(fixed.SCHOLARLY_HOSTS), lambda g: belongs(h, g))
    return known | h.endswith(".edu") | h.endswith(".ac.uk") | h.isin(fixed.RESEARCH_HOSTS) | h.endswith(".research.google") | path(url).contains("/doi/")


def is_institutional(h: Column) -> Column:
    return h.endswith(".gov") | h.endswith(".edu") | h.endswith(".int") | h.endswith(".ac.uk")


def fetch_urls(primary: Column, html: Column, pdf: Column) -> Column:
    """Places to fetch a result from, in order, distinct by canonical key."""
    pdf_last = pdf.endswith(".pdf") & ~html.endswith(".pdf")
    both = F.when(F.coalesce(pdf_last, F.lit(False)), F.array(html, pdf)).otherwise(F.array(pdf, html))
    every = F.filter(F.concat(F.transform(both, parse), F.array(parse(primary))), lambda u: u.isNotNull())
    keys = F.transform(every, canonical)
    at = F.transform(F.array_distinct(keys), lambda k: F.array_position(keys, k).cast("int") - 1)
    return F.transform(at, lambda i: F.get(every, i))


def source_identity(url: Column) -> Column:
    """Who stands behind a page: the repository on code hosts, the package on package hosts, else the site."""
    h = F.regexp_replace(host(url), r"^(www\.)+", "")
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    owner, name = F.lower(F.get(segments, 0)), F.lower(F.get(segments, 1))
    repository = h.isin("github.com", "gitlab.com", "codeberg.org") & (F.size(segments) >= 2) & ~owner.isin("orgs", "search", "topics", "users")
    package = h.isin("docs.rs", "crates.io", "lib.rs") & (F.size(segments) >= 1)
    named = F.when(owner.isin("crate", "crates") & (F.size(segments) >= 2), name).otherwise(owner)
    return F.when(repository, F.concat_ws("/", h, owner, name)).when(package, F.concat_ws("/", h, named)).otherwise(registrable(h))


def docs_scope(query_tokens: Column, url: Column) -> Column:
    """On docs.rs the package in the path must be a token of the query; elsewhere true."""
    segments = F.split(F.regexp_replace(path(url), "^/", ""), "/")
    package = F.when(F.get(segments, 0) == "crate", F.get(segments, 1)).otherwise(F.get(segments, 0))
    return F.when(host(url) == "docs.rs", F.coalesce(F.array_contains(query_tokens, F.lower(package)), F.lit(False))).otherwise(True)


def question(url: Column) -> Column:
    """(site, id) of a question page of the question-and-answer network, else null."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    site = F.when(h.isin("stackoverflow.com", "superuser.com", "serverfault.com", "askubuntu.com"), F.regexp_extract(h, r"^([^.]+)\.com$", 1))
    site = F.coalesce(site, F.nullif(F.regexp_extract(h, r"^([a-z0-9-]+)\.stackexchange\.com$", 1), F.lit("")))
    number = F.regexp_extract(path(url), r"^/(?:questions|q)/([0-9]{1,20})(?:/|$)", 1).try_cast("decimal(20,0)")
    return F.when(site.isNotNull() & number.isNotNull(), F.struct(site.alias("site"), number.alias("id")))


def is_public_ipv4(address: Column) -> Column:
    """False for reserved, private, shared, documentation, multicast and malformed addresses."""
    o = F.transform(F.split(address, "[.]"), lambda x: x.try_cast("int"))
    a, b, c = F.get(o, 0), F.get(o, 1), F.get(o, 2)
    reserved = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return address.rlike(r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$") & F.forall(o, lambda x: F.coalesce(x <= 255, F.lit(False))) & ~reserved


def ipv6_groups(literal: Column) -> Column:
    """The eight numbers of an IPv6 literal (without brackets); null if it is malformed."""
    dotted = F.transform(F.split(F.regexp_extract(literal, r"([0-9]{1,3}(?:[.][0-9]{1,3}){3})$", 1), "[.]"), lambda x: x.try_cast("int"))
    pair = lambda i: F.lower(F.hex(F.get(dotted, i) * 256 + F.get(dotted, i + 1)))
    four = F.forall(dotted, lambda x: F.coalesce(x <= 255, F.lit(False)))
    plain = F.when(F.contains(literal, F.lit(".")), F.when(four, F.concat(F.regexp_replace(literal, r"[0-9.]+$", ""), pair(0), F.lit(":"), pair(2)))).otherwise(literal)
    sides = F.split(plain, "::")
    part = lambda i: F.filter(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda x: x != "")
    left, right = part(0), part(1)
    short = F.size(sides) == 2
    missing = F.lit(8) - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    tidy = ~plain.rlike(":::") & (short | ~plain.rlike("^:|:$")) & (F.size(sides) <= 2) & F.when(short, missing >= 1).otherwise(missing == 0)
    good = tidy & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(good, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def is_public_ipv6(literal: Column) -> Column:
    """False for unspecified, loopback, multicast, local, documentation, benchmarking and malformed literals, and where a
    mapped or compatible IPv4 address is not public."""
    def rule(g: Column) -> Column:
        at = lambda i: F.get(g, i)
        bits = lambda i, mask: at(i).bitwiseAND(F.lit(mask))
        low = lambda i: F.concat_ws(".", F.shiftright(at(i), 8).cast("string"), bits(i, 255).cast("string"))
        inside = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & at(5).isin(0, 0xFFFF)
        local = (
            (bits(0, 0xFF00) == 0xFF00)
            | (bits(0, 0xFE00) == 0xFC00)
            | bits(0, 0xFFC0).isin(0xFE80, 0xFEC0)
            | ((at(0) == 0x64) & (at(1) == 0xFF9B) & (at(2) == 1))
            | ((at(0) == 0x2001) & at(1).isin(0xDB8, 2))
        )
        return F.when(inside, is_public_ipv4(F.concat_ws(".", low(6), low(7)))).otherwise(~local)

    return F.coalesce(let(ipv6_groups(F.lower(literal)), lambda g: F.when(g.isNotNull(), rule(g))), F.lit(False))


def is_fetchable(url: Column) -> Column:
    """May a page be fetched from here: http(s), no credentials, no local name, no reserved address."""
    h = host(url)
    literal = F.nullif(F.regexp_extract(url, r"(?i)^https?://\[([0-9a-f:.]+)\](?:[:/?#]|$)", 1), F.lit(""))
    numeric = h.rlike(r"^[0-9.]+$")
    good = url.rlike("(?i)^https?://") & ~url.rlike(r"^[a-zA-Z]+://[^/?#]*@")
    named = h.isNotNull() & ~(h == "localhost") & ~h.endswith(".localhost") & ~h.startswith("[") & (~numeric | is_public_ipv4(h))
    return F.coalesce(good & F.when(literal.isNotNull(), is_public_ipv6(literal)).otherwise(named), F.lit(False))
