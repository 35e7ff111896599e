"""Bundled advisories: packages with the last version known to be affected.

Package, version bound, advisory id and severity are fixed values. The bounds have no lower
end, and the table is not split by ecosystem. The summary sentences are ours.
"""

# (package, last affected version, advisory, severity, problem, first fixed version)
ADVISORIES = [
    ("django", "2.2.27", "CVE-2022-28346", "CRITICAL", "Crafted keyword names in queryset annotations lead to SQL injection.", "3.2.13"),
    ("django", "3.2.12", "CVE-2022-28346", "CRITICAL", "Crafted keyword names in queryset annotations lead to SQL injection.", "3.2.13"),
    ("flask", "0.12.4", "CVE-2018-1000656", "HIGH", "JSON bodies in odd encodings exhaust the memory of the server.", "1.0"),
    ("pillow", "9.0.1", "CVE-2022-22815", "HIGH", "A crafted image reaches paths and memory it should not.", "9.1.0"),
    ("requests", "2.19.1", "CVE-2018-18074", "MEDIUM", "Credentials travel along when a redirect leaves HTTPS.", "2.20.0"),
    ("pyyaml", "5.3.1", "CVE-2020-14343", "CRITICAL", "Loading a hostile document with the full loader runs code.", "5.4"),
    ("cryptography", "41.0.0", "CVE-2023-38325", "HIGH", "SSH certificates are handled wrongly and can crash the process.", "41.0.1"),
    ("paramiko", "2.9.5", "CVE-2022-24302", "MEDIUM", "A private key file is readable for a moment while it is written.", "2.10.1"),
    ("sqlalchemy", "1.4.45", "CVE-2023-30534", "HIGH", "Crafted filter input reaches the generated statement.", "1.4.46"),
    ("urllib3", "1.26.4", "CVE-2021-33503", "HIGH", "A crafted authority part makes URL parsing run without end.", "1.26.5"),
    ("celery", "4.4.6", "CVE-2021-23727", "HIGH", "Stored task metadata can inject commands into the worker.", "5.2.2"),
    ("lodash", "4.17.20", "CVE-2021-23337", "HIGH", "The template function runs commands hidden in its options.", "4.17.21"),
    ("express", "4.17.2", "CVE-2022-24999", "HIGH", "Nested query parameters can hang the process.", "4.18.2"),
    ("axios", "0.21.1", "CVE-2021-3749", "HIGH", "Trimming a crafted header value runs without end.", "0.21.2"),
    ("node-fetch", "2.6.6", "CVE-2022-0235", "HIGH", "Secret headers are passed on when a redirect leaves the site.", "2.6.7"),
    ("minimist", "1.2.5", "CVE-2021-44906", "CRITICAL", "Crafted arguments change the prototype of all objects.", "1.2.6"),
    ("jsonwebtoken", "8.5.1", "CVE-2022-23529", "HIGH", "A hostile key object bypasses the verification of tokens.", "9.0.0"),
]
