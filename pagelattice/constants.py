"""Fixed values of the feature definitions: word lists, tag groups, type names."""

# Keywords.
CREDENTIAL_WORDS = ("login", "signin", "sign-in", "log-in", "password", "passwd", "credential", "authenticate", "auth", "sso", "oauth")
URGENCY_WORDS = (
    "verify", "confirm", "suspend", "expire", "urgent", "immediate", "alert", "warning", "locked", "unlock", "restrict", "restore",
    "update", "secure", "unusual", "unauthorized", "limited",
)
TARGET_WORDS = ("bank", "banking", "paypal", "wallet", "payment", "billing", "invoice", "transaction", "transfer", "refund")
ACTION_WORDS = ("submit", "continue", "proceed", "click", "download", "install", "enable", "activate", "accept")
BRAND_WORDS = (
    "microsoft", "apple", "google", "amazon", "facebook", "netflix", "linkedin", "dropbox", "adobe", "paypal", "chase", "wellsfargo",
    "dhl", "usps", "fedex", "instagram", "whatsapp", "telegram",
)
CUE_WORDS = CREDENTIAL_WORDS + URGENCY_WORDS + TARGET_WORDS

# Tag groups.
TAG_GROUPS = {
    "form_node_ratio": ("form", "fieldset", "legend"),
    "input_node_ratio": ("input", "textarea", "select", "option"),
    "interactive_node_ratio": ("button", "a", "select", "input", "label"),
    "semantic_tag_ratio": ("header", "nav", "main", "article", "section", "aside", "footer"),
    "div_span_ratio": ("div", "span"),
    "media_node_ratio": ("img", "video", "audio", "svg", "canvas", "picture"),
    "table_node_ratio": ("table", "tr", "td", "th", "thead", "tbody"),
}
INPUT_TAGS = TAG_GROUPS["input_node_ratio"]
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd")

# URL vocabulary.
SUSPICIOUS_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".buzz", ".club", ".work", ".info")
URL_STOP_WORDS = ("http", "https", "www", "com", "org", "net", "html", "php", "asp")
URL_SUSPICIOUS_WORDS = (
    "login", "verify", "secure", "update", "account", "signin", "bank", "paypal", "confirm", "password", "credential", "alert",
    "wallet", "billing", "suspend", "restore",
)
# Query keys whose values are masked, key-shaped tokens, and marks of obfuscated scripts.
SENSITIVE_KEYS = (
    "key", "apikey", "api_key", "access_token", "accesstoken", "token", "auth", "authorization", "client_secret", "secret",
    "password", "pass", "pw", "signature", "sig",
)
SECRET_TOKEN = r"(?:AIza[0-9A-Za-z_-]{30,}|ya29\.[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{20,})"
OBFUSCATION = r"(?i)(eval\s*\(|atob\s*\(|fromCharCode|unescape\s*\(|\\x[0-9a-f]{2})"
# Two-level public suffixes that the bundled list knows beside the last label.
TWO_LEVEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.nz", "co.za", "com.tr", "com.tw", "com.sg")

HTML, SCRIPT, NETWORK, STORAGE = "html", "script", "network", "storage"
STRUCTURE, EXECUTE, REQUEST, ACCESS = "structure", "execute", "request", "access"

# The 101 feature names by group, in canonical order.
FEATURE_GROUPS = {
    "content_url_lexical": (
        "url_length", "domain_length", "path_length", "query_length", "tld_length", "num_dots_in_url", "num_hyphens_in_domain",
        "num_digits_in_domain", "num_digits_in_url", "num_slashes_in_url", "num_slashes_in_domain", "num_subdomains", "path_depth",
        "num_special_chars", "has_at_symbol", "has_double_slash_redirect", "has_ip_address", "is_https", "has_suspicious_tld",
    ),
    "content_url_entropy_token": ("url_entropy", "domain_entropy", "num_url_tokens", "num_suspicious_tokens", "suspicious_token_ratio"),
    "content_html_phishing_cue": (
        "phishing_keyword_in_nodes", "credential_keyword_depth", "brand_keyword_in_nodes", "brand_in_text_not_domain",
        "urgency_keyword_ratio", "external_brand_resource", "action_keyword_in_form", "obfuscation_indicator",
    ),
    "content_html_content": (
        "data_uri_node_ratio", "empty_link_node_ratio", "html_length", "num_password_inputs", "num_hidden_inputs", "num_iframes",
        "has_title", "title_length", "has_favicon", "favicon_external",
    ),
    "structural_graph_topology": (
        "graph_density", "graph_diameter", "graph_avg_shortest_path", "graph_clustering_coefficient", "graph_num_components",
        "graph_largest_component_ratio", "graph_assortativity", "graph_transitivity", "average_degree_connectivity",
    ),
    "structural_dom_shape": ("dom_depth_max", "dom_depth_avg", "dom_breadth_max", "dom_leaf_ratio"),
    "structural_centrality_hierarchy": (
        "closeness_centrality_mean", "closeness_centrality_std", "closeness_centrality_max", "closeness_centrality_min",
        "ancestors_mean", "ancestors_std", "ancestors_max", "ancestors_min",
        "descendants_mean", "descendants_std", "descendants_max", "descendants_min",
    ),
    "structural_node_type_distribution": ("html_node_ratio", "script_node_ratio", "request_node_ratio", "storage_node_ratio", *TAG_GROUPS),
    "structural_edge_type_distribution": (
        "structure_edge_ratio", "request_edge_ratio", "execute_edge_ratio", "access_edge_ratio", "redirect_edge_ratio",
        "cross_domain_edge_ratio", "avg_edge_type_entropy",
    ),
    "behavioral_subgraph_path": (
        "form_subgraph_size", "form_subgraph_ratio", "form_subgraph_depth", "input_to_root_avg_distance", "script_to_input_path_length",
        "resource_dependency_depth", "exfil_path_length", "non_form_content_ratio",
    ),
    "behavioral_edge_interaction": ("form_to_external_edge", "script_to_form_path_exists"),
    "behavioral_data_flow": (
        "form_data_exfil_path", "input_to_request_flow", "cookie_set_with_form", "storage_to_request_flow", "redirect_to_form_pattern",
        "form_to_redirect_pattern",
    ),
}
FEATURE_NAMES = tuple(name for group in FEATURE_GROUPS.values() for name in group)
CATEGORY_OF = {"content": "C", "structural": "S", "behavioral": "B"}


def features_of(categories: str) -> list[str]:
    """Feature names of the categories in ``categories`` ("C", "S", "B", "CS" ...), in canonical order."""
    return [name for group, names in FEATURE_GROUPS.items() if CATEGORY_OF[group.split("_")[0]] in categories for name in names]
