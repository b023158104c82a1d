"""What a URL or a page is: categories, products, platforms, rendering. JVM-side expressions.

Each word list below holds fixed values of the rule that uses it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from catloom.functions import urls

CATEGORY_MARKS = (
    "/categoria", "/category", "/collection", "/colecao", "/busca", "/search", "/c/", "/produtos", "/products", "/shop",
    "/brincos", "/aneis", "/colares", "/pulseiras", "/ouro", "/prata", "/pedras", "/feminino", "/masculino", "/infantil",
    "/lancamento", "/promocao", "/outlet",
)
NO_PRODUCT_MARKS = (
    "/carrinho", "/cart", "/checkout", "/conta", "/account", "/login", "/blog", "/contato", "/contact", "/sobre", "/about",
    "/faq", "/ajuda", "/help", "/politica", "/termos", "/privacy", "/categoria", "/category", "/collection", "/colecao",
    "/c/", "/busca", "/search", "/produtos", "/products", "/shop", "/automotivo", "/casa", "/ferramentas", "/eletrica", "/hidraulica",
)
STRONG_PRODUCT = (r"/[a-z]+-\d{6,}$", r"-\d{6,}$", r"/p/\d+", r"/produto/", r"/product/", r"/item/", r"/look-\d+")
ALLOWED = (r"/produto/", r"/product/", r"/p/", r"/item/", r"/pd/", r"/dp/", r"-p-\d+", r"/[a-z0-9\-]+/p$")
DENIED = (
    "/categoria", "/category", "/busca", "/search", "/institucional", "/sobre", "/contato", "/ajuda", "/carrinho", "/cart",
    "/checkout", "/login", "/account", "/conta", "/perfil", "/wishlist", ".pdf", ".jpg", ".png", ".gif", ".css", ".js",
)
PRODUCT_MARKERS = ("/produto/", "/product/", "/produtos/", "/item/", "/p/")
INSTITUTIONAL = (
    "/atendimento", "/quemsomos", "/contato", "/politica", "/termos", "/duvidas", "/trocas", "/entrega", "/compra",
    "/pagamento", "/receita", "/carrinho", "/checkout", "/login", "/cadastro", "/conta", "/pedidos", "/favoritos",
    "/home-", "/dia-", "/outlet", "/frete", "/formas", "/nossos",
)
#: Category, its key words; the first that matches wins.
KEYWORD_CATEGORIES = (
    ("Brinquedos", ("brinquedo", "jogo", "boneca", "carrinho")),
    ("Beleza e Cuidado Pessoal", ("beleza", "cabelo", "unha", "cuidado")),
    ("Casa e Decoração", ("casa", "cozinha", "decoracao", "movel")),
    ("Ferramentas", ("ferramenta", "chave", "martelo")),
)
OTHER_CATEGORY = "Utilidades Domésticas"
#: Three groups of page indicators, and seven single ones.
INDICATOR_GROUPS = (
    ("adicionar", "comprar", "buy", "add to cart"),
    ('"price"', "preco", "preço", "r$", "brl"),
    ("product", "produto", '"sku"', "item"),
)
INDICATORS = ("application/ld+json", "og:type", "product", "price", "add to cart", "buy now", "comprar")
PLATFORMS = (
    ("VTEX", ("vtex",)),
    ("SHOPIFY", ("shopify", "myshopify.com", "cdn.shopify.com")),
    ("WOOCOMMERCE", ("woocommerce", "wp-content")),
    ("MAGENTO", ("magento", "mage")),
    ("NUVEMSHOP", ("nuvemshop",)),
)
FRAMEWORKS = ("react", "vue", "angular", "next", "__next", "nuxt", "gatsby")
FINGERPRINTERS = ("fingerprint", "datadome", "perimeterx", "distil", "incapsula")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True if the text contains one of the words."""
    return text.rlike("|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ") for w in words))


def category_like(url: Column) -> Column:
    return any_of(F.lower(url), CATEGORY_MARKS)


def product_like(url: Column) -> Column:
    """No excluded mark, some path, and a run of six digits or a strong product form in the path."""
    own = F.rtrim(urls.path(url), F.lit("/"))
    strong = own.rlike(r"\d{6,}") | own.rlike("|".join(f"(?:{p})" for p in STRONG_PRODUCT))
    return ~any_of(F.lower(url), NO_PRODUCT_MARKS) & own.contains("/") & strong


#: Forms of a product, and pages that are none, of the simple rule (fixed values).
SIMPLE_PRODUCT = r"/produtos?/|/products?/|/p/|-\d{3,}"
SIMPLE_OTHER = r"/(categoria|category|blog|contato|contact|carrinho|cart|busca|search|login|account)/"


def product_simple(url: Column) -> Column:
    """A product word or three digits after a hyphen, and neither a utility page nor a root."""
    low = F.lower(url)
    return low.rlike(SIMPLE_PRODUCT) & ~low.rlike(SIMPLE_OTHER) & ~low.rlike(r"^https?://[^/]+/?$")


def product_allowed(url: Column, site: Column) -> Column:
    """On the site, and in an allowed form or at least not in a denied one."""
    low = F.lower(url)
    page = ~url.rlike(r"^(#|javascript:|mailto:|tel:)") & F.coalesce(F.contains(urls.authority(url), site), F.lit(False))
    return page & (low.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | ~any_of(low, DENIED))


def product_marker(url: Column) -> Column:
    return any_of(F.lower(url), PRODUCT_MARKERS)


def homepage_product(url: Column) -> Column:
    """A cleaned product link as the homepage discovery keeps it: deep, and a long hyphenated last part."""
    parts = F.split(url, "/")
    last = F.element_at(parts, -1)
    return (F.size(parts) >= 5) & last.contains("-") & (F.length(last) > 10)


def category_candidate(url: Column) -> Column:
    """One short path segment that does not end in a number."""
    own = urls.segments(url)
    first = F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(""))
    return (F.size(own) == 1) & ~first.rlike(r"-\d+$") & (F.length(first) < 30)


def institutional(url: Column) -> Column:
    return any_of(F.lower(urls.path(url)), INSTITUTIONAL)


def keyword_category(text: Column) -> Column:
    low, out = F.lower(text), F.lit(OTHER_CATEGORY)
    for name, words in reversed(KEYWORD_CATEGORIES):
        out = F.when(any_of(low, words), F.lit(name)).otherwise(out)
    return out


def indicator_groups(html: Column) -> Column:
    """How many of the three indicator groups (buy, price, product) a page shows."""
    low = F.lower(html)
    return sum((any_of(low, g).cast("int") for g in INDICATOR_GROUPS), F.lit(0))


def indicators(html: Column) -> Column:
    """How many of the seven indicators a page shows."""
    low = F.lower(html)
    return sum((low.contains(w).cast("int") for w in INDICATORS), F.lit(0))


def page_is_product(html: Column, by: str = "groups") -> Column:
    """Two groups or two indicators at least."""
    return (indicator_groups(html) if by == "groups" else indicators(html)) >= 2


def platform(html: Column, rule: str = "first") -> Column:
    """``first``: first match, and ``mage`` alone is no evidence; ``last``: the last match, ``mage`` counts."""
    low, out = F.lower(html), F.lit(None).cast("string")
    order = PLATFORMS if rule == "last" else tuple(reversed(PLATFORMS))
    for name, words in order:
        own = tuple(w for w in words if rule == "last" or w != "mage")
        out = F.when(any_of(low, own), F.lit(name)).otherwise(out)
    return out


def platform_evidence(html: Column) -> Column:
    """All platforms with a match, in order."""
    low = F.lower(html)
    found = F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in PLATFORMS])
    return F.filter(found, lambda x: x.isNotNull())


def scripts(html: Column) -> Column:
    """Opening tags and bodies of the scripts."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b.*?</script>"), F.lit(0))


def has_price(html: Column) -> Column:
    return html.rlike(r"(?i)R\$\s*[\d.,]+") | html.rlike(r"(?i)itemprop=[\"']price[\"']") | html.rlike(r"application/ld\+json")


def dynamic_score(html: Column, seconds: Column) -> Column:
    """Points for rendering in the browser: 2 a framework script, 3 a hydrating one, 2 a root element, 3 no price, 1 slow."""
    first = F.slice(scripts(html), 1, 20)
    points = F.aggregate(
        first,
        F.lit(0),
        lambda acc, s: acc + F.when(any_of(F.lower(s), FRAMEWORKS), 2).otherwise(0) + F.when(F.lower(s).contains("hydrat"), 3).otherwise(0),
    )
    root = html.rlike(r"(?i)<div[^>]*\bid=[\"'][^\"']*(root|app|__next)")
    return points + F.when(root, 2).otherwise(0) + F.when(has_price(html), 0).otherwise(3) + F.when(seconds > 1.5, 1).otherwise(0)


def rendering(text_length: Column) -> Column:
    """``SSR`` if the page has over 1000 characters of text before any script runs."""
    return F.when(text_length > 1000, F.lit("SSR")).otherwise(F.lit("CSR"))


#: Marks of frameworks in a captured page (fixed names).
FRAMEWORK_MARKS = (
    ("Next.js", r"__NEXT_DATA__"),
    ("React", r"data-reactroot|data-reactid"),
    ("Vue.js", r"\sdata-v-"),
    ("Angular", r"ng-version"),
    ("jQuery", r"(?i)jquery[^\"'<>]*\.js"),
    ("Gatsby", r"___gatsby"),
    ("Nuxt.js", r"__NUXT__"),
)


def frameworks(html: Column) -> Column:
    """Frameworks whose marks a page has, in this order."""
    return F.filter(F.array(*[F.when(html.rlike(p), F.lit(n)) for n, p in FRAMEWORK_MARKS]), lambda x: x.isNotNull())


def protection_flags(html: Column, headers: Column) -> Column:
    """What guards a page, for reports only."""
    low = F.lower(html)
    own = F.filter(scripts(html), lambda s: any_of(F.lower(s), FINGERPRINTERS))
    return F.struct(
        (low.contains("cloudflare") | F.lower(headers).contains("cf-ray")).alias("cdn"),
        low.contains("captcha").alias("captcha"),
        F.size(own).alias("fingerprint_scripts"),
        F.lower(headers).rlike("rate|limit|retry-after").alias("rate_limited"),
    )


def recommendations(jsonld: Column, apis: Column, next_data: Column, rate_limited: Column) -> Column:
    """Reading strategies in order of priority; the markup itself and the mixed cascade always close the list."""
    options = F.array(
        F.when(jsonld, F.lit("json-ld")),
        F.when(apis > 0, F.lit("api")),
        F.when(next_data, F.lit("hydration")),
        F.when(rate_limited, F.lit("paced-requests")),
        F.lit("dom"),
        F.lit("cascade"),
    )
    return F.filter(options, lambda x: x.isNotNull())


def route(url: Column, rules: list[tuple[str, str]], default: str = "generic") -> Column:
    """Reader of a URL: the first rule ``(substring, reader)`` that matches its lower-case form."""
    low, out = F.lower(url), F.lit(default)
    for mark, reader in reversed(rules):
        out = F.when(low.contains(mark), F.lit(reader)).otherwise(out)
    return out


def status_label(status: Column) -> Column:
    """``missing`` for 404, ``failed`` from 400 on or without a status, else ``ok``."""
    return F.when(status == 404, "missing").when(status.isNull() | (status >= 400), "failed").otherwise("ok")


def too_small(html: Column, least: int = 1000) -> Column:
    """A page of fewer than ``least`` characters is an error page."""
    return F.length(html) < least


def quality_label(share: Column, levels: tuple[float, float] = (95.0, 80.0)) -> Column:
    """Percent of successes as a word."""
    return F.when(share >= levels[0], "excellent").when(share >= levels[1], "good").otherwise("poor")
