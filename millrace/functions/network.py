"""URLs, addresses of the internet and user agents."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit, urlunsplit

from millrace.functions.registry import kernel, parse

EXPRESSIONS = parse("url", r"""
url_scheme(u STRING) STRING = lower(try_parse_url(u, 'PROTOCOL')) ;; url_scheme(url) ;; regexp_extract(url, '^([a-z]+)://', 1)
url_host(u STRING) STRING = lower(try_parse_url(u, 'HOST')) ;; url_host(url) ;; regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)
url_port(u STRING) INT = coalesce(try_cast(regexp_extract(try_parse_url(u, 'AUTHORITY'), ':([0-9]+)$', 1) AS INT), CASE lower(try_parse_url(u, 'PROTOCOL')) WHEN 'http' THEN 80 WHEN 'https' THEN 443 WHEN 'ftp' THEN 21 END) ;; url_port(url) ;; CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END
url_path(u STRING) STRING = try_parse_url(u, 'PATH') ;; url_path(url) ;; regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)
url_query(u STRING) STRING = try_parse_url(u, 'QUERY') ;; url_query(url) ;; nullif(regexp_extract(url, '\?([^#]*)', 1), '')
url_fragment(u STRING) STRING = try_parse_url(u, 'REF') ;; url_fragment(url) ;; nullif(regexp_extract(url, '#(.*)$', 1), '')
url_param(u STRING, k STRING) STRING = url_decode(try_parse_url(u, 'QUERY', k)) ;; url_param(url, 'page') ;; nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')
is_ipv4(s STRING) INT = CAST(s RLIKE '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.(?!$)|$)){4}$' AS INT)
inet_aton(s STRING) BIGINT = if(is_ipv4(s) = 1, aggregate(split(s, '\\.'), 0L, (a, p) -> a * 256 + int(p)), NULL)
inet_ntoa(n BIGINT) STRING = if(n BETWEEN 0 AND 4294967295, concat_ws('.', shiftright(n, 24) & 255, shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255), NULL) ;; inet_ntoa(page_id + 3232235776L) ;; ((page_id + 3232235776) >> 24) || '.' || (((page_id + 3232235776) >> 16) & 255) || '.' || (((page_id + 3232235776) >> 8) & 255) || '.' || ((page_id + 3232235776) & 255)
""")


def quiet(f):
    """f, with None for what is no address or URL."""

    def run(*args):
        try:
            return f(*args)
        except ValueError:
            return None

    return run


def network(s: str):
    return ipaddress.ip_network(s, strict=False)


def normalise(u: str) -> str:
    p = urlsplit(u.strip())
    port = "" if p.port in (None, {"http": 80, "https": 443}.get(p.scheme.lower())) else f":{p.port}"
    return urlunsplit((p.scheme.lower(), (p.hostname or "") + port, p.path or "/", p.query, p.fragment))


def merged(a: str, b: str) -> str:
    x, y = network(a), network(b)
    while x.prefixlen and not y.subnet_of(x):
        x = x.supernet()
    return str(x)


def agent(ua: str) -> tuple[str | None, str | None]:
    """(browser, system) of a user agent, by the marks that each sends."""
    browsers = (("Googlebot", "Googlebot"), ("bingbot", "bingbot"), ("Edg/", "Edge"), ("OPR/", "Opera"), ("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Safari/", "Safari"), ("curl/", "curl"))
    systems = (("Windows", "Windows"), ("Android", "Android"), ("iPhone", "iPhone"), ("iPad", "iPad"), ("Mac OS X", "Mac OSX"), ("Linux", "Linux"))
    first = lambda marks: next((name for mark, name in marks if mark in ua), None)
    return first(browsers), first(systems)


KERNELS = [
    kernel("ip", "ip_family", "long", quiet(lambda s: network(s).version)),
    kernel("ip", "ip_in_cidr", "long", quiet(lambda a, c: int(ipaddress.ip_address(a) in network(c)))),
    kernel("ip", "ip_host", "string", quiet(lambda c: str(ipaddress.ip_interface(c).ip))),
    kernel("ip", "ip_network", "string", quiet(lambda c: str(network(c).network_address))),
    kernel("ip", "ip_broadcast", "string", quiet(lambda c: str(network(c).broadcast_address))),
    kernel("ip", "ip_prefix_len", "long", quiet(lambda c: network(c).prefixlen)),
    kernel("ip", "ip_contains", "long", quiet(lambda a, b: int(network(a).version == network(b).version and network(b).subnet_of(network(a))))),
    kernel("ip", "inet_same_family", "long", quiet(lambda a, b: int(network(a).version == network(b).version))),
    kernel("ip", "inet_merge", "string", quiet(merged)),
    kernel("ip", "inet6_aton", "binary", quiet(lambda s: ipaddress.ip_address(s).packed)),
    kernel("ip", "inet6_ntoa", "string", quiet(lambda b: str(ipaddress.ip_address(bytes(b))))),
    kernel("ip", "is_ipv6", "long", lambda s: int(quiet(ipaddress.IPv6Address)(s) is not None)),
    kernel("ip", "is_ipv4_mapped", "long", lambda s: int(getattr(quiet(ipaddress.IPv6Address)(s), "ipv4_mapped", None) is not None)),
    kernel("url", "url_normalize", "string", quiet(normalise)),
    kernel("url", "url_join", "string", urljoin),
    kernel("url", "ua_browser", "string", lambda s: agent(s)[0]),
    kernel("url", "ua_os", "string", lambda s: agent(s)[1]),
]

FUNCTIONS = [*EXPRESSIONS, *KERNELS]
