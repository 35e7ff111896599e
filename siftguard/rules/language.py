"""Detectors for source code: 41 live rules in seven families.

Titles, severities, CWE ids, suffix gates and patterns are fixed values: baselines,
suppression comments and history tables refer to them. Descriptions and advice are
free text. Patterns use only syntax that Java, Python and RE2 read alike.
"""

from __future__ import annotations

from .model import Rule

PY = (".py",)
JS = (".js", ".ts")
WEB = (".js", ".ts", ".jsx", ".tsx", ".html")
PHP = (".php",)
JAVA = (".java",)
SQL_FILES = (".py", ".php", ".js", ".ts", ".java", ".rb", ".go")
PATH_FILES = (".py", ".js", ".ts", ".php", ".rb", ".java")
LOG_FILES = (".py", ".js", ".ts", ".php", ".java")

_VERBS = ("select", "insert", "update", "delete", "drop", "alter", "union")
_CREDENTIALS = ("password", "passwd", "pwd", "secret", "token", "api_key", "credit_card",
                "ssn", "cvv", "pin", "auth")

SQL_INJECTION = [
    Rule("SQL1", "sql_injection", "CRITICAL", "CWE-89",
         "SQL Injection — String Concatenation in Query",
         r"""(?i)(execute|executemany|raw|cursor\.execute)\s*\(\s*(f['"]{1,3}.*?(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|WHERE).*?['"]{1,3}|['"]\s*(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION|WHERE).*?['"]\s*[+%]|(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION)\s+.*?%\s*)""",
         "The statement text handed to the database is assembled from variables, so whoever controls them can rewrite the query.",
         "Bind values as parameters instead of building the text:\n  cur.execute('SELECT name FROM accounts WHERE id = %s', (account_id,))",
         exts=SQL_FILES, needs=(("(",), ("execute", "raw"), (*_VERBS, "create", "where"))),
    Rule("SQL2", "sql_injection", "HIGH", "CWE-89",
         "SQL Injection — Potential Dynamic Query Construction",
         r"""(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|UNION).*?(\.format\(|\s*%\s*[\(\[]|f["'])""",
         "An SQL verb shares the line with string formatting; the query is injectable if any formatted value comes from outside.",
         "Pass values as bound parameters, or let a query builder assemble optional filters.",
         exts=SQL_FILES, needs=((".format(", "%", "f\"", "f'"), _VERBS)),
    Rule("SQL3", "sql_injection", "HIGH", "CWE-89",
         "SQL Injection — ORM raw() with Dynamic Input",
         r"""(?i)\.(raw|extra|RawSQL)\s*\(\s*(f['"]+|['"]+.*?[+%]|.*?\.format)""",
         "A raw ORM query is built by interpolation, which bypasses the escaping the ORM would apply.",
         "Keep the text constant and hand values over separately:\n  Account.objects.raw('SELECT * FROM account WHERE id = %s', [account_id])",
         exts=PY, needs=(("(",), (".raw", ".extra"),)),
]

COMMAND_INJECTION = [
    Rule("CMD1", "command_injection", "HIGH", "CWE-78",
         "Command Injection — os.system / os.popen",
         r"os\.(system|popen|startfile)\s*\(",
         "These calls give the whole command line to a shell, which interprets any metacharacter in it.",
         "Start the program without a shell and give the arguments as a list:\n  subprocess.run(['ls', '-l', folder], check=True)",
         exts=PY, needs=(("(",), ("os.system", "os.popen", "os.startfile"),)),
    Rule("CMD2", "command_injection", "CRITICAL", "CWE-78",
         "Command Injection — subprocess with shell=True",
         r"subprocess\.(call|run|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True",
         "With shell=True the command string goes through a shell, so outside data in it can run other commands.",
         "Leave the shell out and pass a list:\n  subprocess.run(['tool', option, value])",
         exts=PY, needs=(("(",), ("subprocess.",), ("shell",))),
    Rule("CMD3", "command_injection", "CRITICAL", "CWE-95",
         "Code Injection — eval() with dynamic argument",
         r"""\beval\s*\((\s*[^\s'"]|\s*$)""",
         "eval() runs its argument as program code; an argument that is not a literal may come from an attacker.",
         "Parse literals with ast.literal_eval(), or restructure so that no code is evaluated.",
         exts=PY, needs=(("(",), ("eval",),)),
    Rule("CMD4", "command_injection", "CRITICAL", "CWE-95",
         "Code Injection — exec() with dynamic argument",
         r"""\bexec\s*\((\s*[^\s'"]|\s*$)""",
         "exec() runs arbitrary statements, so outside data must never reach it.",
         "Replace exec() by ordinary functions or a dispatch table.",
         exts=PY, needs=(("(",), ("exec",),)),
    Rule("CMD5", "command_injection", "CRITICAL", "CWE-78",
         "Command/Code Injection — Dangerous JS Execution",
         r"(?i)(child_process\.(exec|execSync|spawn|spawnSync)|eval\s*\(|new Function\s*\()",
         "Process launch or dynamic evaluation in JavaScript becomes remote code execution once outside data reaches it.",
         "Use execFile() with an argument array, and drop eval() and the Function constructor.",
         exts=JS, needs=(("child_process.", "eval", "new function"),)),
    Rule("CMD6", "command_injection", "CRITICAL", "CWE-78",
         "Command Injection — PHP Shell Execution Function",
         r"(?i)\b(system|exec|passthru|shell_exec|popen|proc_open)\s*\(",
         "The function starts an operating system command from PHP.",
         "Prefer a native PHP function; where a command is unavoidable, quote each argument with escapeshellarg().",
         exts=PHP, needs=(("(",), ("system", "exec", "passthru", "popen", "proc_open"),)),
]

XSS = [
    Rule("XSS1", "xss", "HIGH", "CWE-79",
         "XSS — mark_safe() with Potentially Unsanitized Data",
         r"\bmark_safe\s*\(",
         "mark_safe() switches template escaping off for the value, so markup inside it reaches the browser.",
         "Let the framework escape the parts:\n  format_html('<b>{}</b>', label)",
         exts=PY, needs=(("(",), ("mark_safe",),)),
    Rule("XSS2", "xss", "HIGH", "CWE-79",
         "XSS — Jinja2 |safe Filter Disables Escaping",
         r"\|\s*safe\b",
         "The safe filter tells the template engine to print the value unescaped.",
         "Remove the filter, or clean the value with an HTML sanitizer first.",
         exts=PY, needs=(("|",), ("safe",))),
    Rule("XSS3", "xss", "HIGH", "CWE-79",
         "XSS — innerHTML Assignment with Non-Literal Value",
         r"""\.innerHTML\s*=(\s|[^=\s'"`]|$)""",
         "Markup in the assigned value becomes part of the page, scripts included.",
         "Write text as text, or sanitize markup:\n  node.textContent = value;\n  node.innerHTML = DOMPurify.sanitize(value);",
         exts=WEB, needs=(("=",), (".innerhtml",),)),
    Rule("XSS4", "xss", "HIGH", "CWE-79",
         "XSS — document.write() with Dynamic Argument",
         r"""document\.write\s*\([^'"`]""",
         "A computed argument to document.write() can add script elements to the page.",
         "Create and append elements through the DOM interface.",
         exts=WEB, needs=(("(",), ("document.write",),)),
    Rule("XSS5", "xss", "MEDIUM", "CWE-79",
         "XSS — React dangerouslySetInnerHTML",
         r"dangerouslySetInnerHTML\s*=\s*\{",
         "This property turns React's escaping off for the element.",
         "Sanitize the markup first:\n  <div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(markup) }} />",
         exts=WEB, needs=(("=",), ("dangerouslysetinnerhtml",),)),
    Rule("XSS6", "xss", "CRITICAL", "CWE-79",
         "XSS — PHP echo with Unsanitized Superglobal",
         r"(?i)echo\s+.*?\$_(GET|POST|REQUEST|COOKIE)\s*\[",
         "Request data is printed into the page as it came in.",
         "Escape on output:\n  echo htmlspecialchars($_GET['q'], ENT_QUOTES);",
         exts=PHP, needs=(("$_",), ("echo",))),
]

PATH_TRAVERSAL = [
    Rule("PTH1", "path_traversal", "HIGH", "CWE-22",
         "Path Traversal — os.path.join with User Input",
         r"os\.path\.join\s*\([^)]*\b(request|user|param|input|filename|path|name)\b",
         "A joined component that a user controls can climb out of the intended folder.",
         "Resolve the result and check that it stays inside:\n  target = (root / name).resolve()\n  if root not in target.parents:\n      raise ValueError(name)",
         exts=PY, needs=(("(",), ("os.path.join",),)),
    Rule("PTH2", "path_traversal", "HIGH", "CWE-22",
         "Path Traversal — Flask send_file with User Input",
         r"send_file\s*\([^)]*\b(request|user|param|filename|path)\b",
         "A path chosen by the user decides which file the server sends.",
         "Serve from one fixed folder only:\n  send_from_directory(DOWNLOADS, secure_filename(name))",
         exts=PY, needs=(("(",), ("send_file",),)),
    Rule("PTH3", "path_traversal", "HIGH", "CWE-22",
         "Path Traversal — String Concatenation with User-Controlled Path",
         r"(?i)(BASE_DIR|ROOT_DIR|UPLOAD_DIR|app\.(root_path|static_folder))\s*[+]\s*\b(request|user|param|filename|path|name)\b|\b(request|user|param|filename|path|name)\b\s*[+]\s*(BASE_DIR|ROOT_DIR|UPLOAD_DIR)",
         "A folder constant is glued to user data without a check of the result.",
         "Clean the name with secure_filename() and verify the resolved path before use.",
         exts=PY, needs=(("+",), ("base_dir", "root_dir", "upload_dir", "app."))),
    Rule("PTH4", "path_traversal", "MEDIUM", "CWE-22",
         "Path Traversal — Literal ../ Sequence in Code",
         r"""['"]\.\.[\\/]""",
         "The code spells out a step to the parent folder; make sure that no user input takes part in it.",
         "Review the path and anchor it to an absolute folder.",
         exts=PATH_FILES, needs=(("'..", "\".."),)),
]

DESERIALIZATION = [
    Rule("DES1", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — pickle.load(s)",
         r"\bpickle\.(loads?|Unpickler)\s*\(",
         "Unpickling runs code chosen by whoever wrote the bytes.",
         "Use a data-only format such as JSON; where pickle must stay, authenticate the bytes first:\n  hmac.compare_digest(expected, given)",
         exts=PY, needs=(("(",), ("pickle.",),)),
    Rule("DES2", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — marshal.load(s)",
         r"\bmarshal\.(loads?|load)\s*\(",
         "marshal is not hardened against hostile bytes and can be made to run code.",
         "Store data as JSON or another data-only format.",
         exts=PY, needs=(("(",), ("marshal.",),)),
    Rule("DES3", "deserialization", "HIGH", "CWE-502",
         "Insecure Deserialization — shelve (uses pickle internally)",
         r"\bshelve\.open\s*\(",
         "A shelf stores pickles, so opening one from elsewhere carries the same danger.",
         "Keep foreign data in a database or a data-only format.",
         exts=PY, needs=(("(",), ("shelve.open",),)),
    Rule("DES4", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — yaml.load() without SafeLoader",
         r"\byaml\.load\s*\([^)]*\)",
         "The full YAML loader builds arbitrary objects named by tags in the document.",
         "Load plain data only:\n  yaml.safe_load(stream)",
         exts=PY, not_pattern=r"SafeLoader|Loader\s*=\s*yaml\.SafeLoader", needs=(("(",), ("yaml.load",),)),
    Rule("DES5", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — jsonpickle.decode",
         r"\bjsonpickle\.(decode|loads?)\s*\(",
         "jsonpickle rebuilds objects of any class and can be made to run code.",
         "Read plain JSON with json.loads().",
         exts=PY, needs=(("(",), ("jsonpickle.",),)),
    Rule("DES6", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — PHP unserialize()",
         r"\bunserialize\s*\(",
         "unserialize() on foreign data allows object injection through magic methods.",
         "Use json_decode(), or forbid classes:\n  unserialize($blob, ['allowed_classes' => false])",
         exts=PHP, needs=(("(",), ("unserialize",),)),
    Rule("DES7", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — Java ObjectInputStream",
         r"\bnew ObjectInputStream\s*\(",
         "Native Java deserialization of foreign bytes is a classic way to remote code execution.",
         "Exchange JSON or protocol buffers, or set an ObjectInputFilter with an allow-list.",
         exts=JAVA, needs=(("(",), ("new objectinputstream",),)),
    Rule("DES8", "deserialization", "CRITICAL", "CWE-502",
         "Insecure Deserialization — node-serialize",
         r"""\brequire\s*\(\s*['"]node-serialize['"]""",
         "The package evaluates functions found in the serialized text.",
         "Remove the package and use JSON.parse() with a schema check.",
         exts=JS, needs=(("(",), ("node-serialize",),)),
]

WEAK_CRYPTO = [
    Rule("CRY1", "weak_crypto", "HIGH", "CWE-327",
         "Weak Crypto — MD5 Hash Function",
         r"""(?i)\bhashlib\.md5\s*\(|\.new\s*\(\s*['"]md5['"]""",
         "MD5 collisions can be produced at will, so it protects neither passwords nor signatures.",
         "Hash with SHA-256, and passwords with a slow scheme:\n  argon2.PasswordHasher().hash(password)",
         exts=PY, needs=(("(",), ("md5",),)),
    Rule("CRY2", "weak_crypto", "MEDIUM", "CWE-327",
         "Weak Crypto — SHA-1 Hash Function",
         r"""(?i)\bhashlib\.sha1\s*\(|\.new\s*\(\s*['"]sha1['"]""",
         "SHA-1 collisions are practical, so it is no longer fit for signatures or integrity.",
         "Move to hashlib.sha256() or hashlib.sha3_256().",
         exts=PY, needs=(("(",), ("sha1",),)),
    Rule("CRY3", "weak_crypto", "HIGH", "CWE-327",
         "Weak Crypto — Broken Cipher (DES / RC4 / Blowfish)",
         r"\b(DES|DES3|ARC4|RC4|Blowfish)\b",
         "The named cipher has a short key or known attacks.",
         "Use an authenticated modern cipher:\n  AESGCM(key).encrypt(nonce, data, None)",
         exts=PY, needs=(("des", "arc4", "rc4", "blowfish"),)),
    Rule("CRY4", "weak_crypto", "HIGH", "CWE-327",
         "Weak Crypto — AES in ECB Mode",
         r"\bMODE_ECB\b|mode\s*=\s*AES\.MODE_ECB",
         "ECB encrypts equal blocks to equal blocks and so shows the structure of the data.",
         "Choose GCM, or CBC with a fresh random IV.",
         exts=PY, needs=(("mode_ecb",),)),
    Rule("CRY5", "weak_crypto", "HIGH", "CWE-326",
         "Weak Crypto — Small RSA/EC Key Size",
         r"generate(?:_private_key|_key)?\s*\(",
         "A key is generated here; RSA keys under 2048 bits can be factored.",
         "Ask for a sufficient size:\n  rsa.generate_private_key(public_exponent=65537, key_size=3072)",
         exts=PY, needs=(("(",), ("generate",),)),
    Rule("CRY6", "weak_crypto", "HIGH", "CWE-338",
         "Weak Crypto — random Module for Security Token",
         r"random\.(random|randint|choice|shuffle|randrange|sample)\s*\(",
         "The random module is predictable and must not produce tokens, codes or keys.",
         "Draw from the operating system:\n  secrets.token_urlsafe(32)",
         exts=PY, needs=(("(",), ("random.",),)),
    Rule("CRY7", "weak_crypto", "CRITICAL", "CWE-295",
         "Weak Crypto — SSL/TLS Certificate Verification Disabled",
         r"verify\s*=\s*False|ssl\._create_unverified_context\s*\(\s*\)|CERT_NONE|check_hostname\s*=\s*False",
         "Without certificate checks anyone on the path can read and change the traffic.",
         "Keep verification on, with a private CA where needed:\n  requests.get(url, verify='/etc/ssl/company-ca.pem')",
         exts=PY, needs=(("verify", "unverified_context", "cert_none", "check_hostname"),)),
    Rule("CRY8", "weak_crypto", "HIGH", "CWE-330",
         "Weak Crypto — Hardcoded IV / Nonce / Salt",
         r"""(?i)(iv|nonce|salt)\s*=\s*b?['"][^'"]{8,}['"]""",
         "A constant IV, nonce or salt removes the randomness the scheme relies on.",
         "Draw a new one for every message:\n  nonce = os.urandom(12)",
         exts=PY, needs=(("=",), ("iv", "nonce", "salt"), ("'", "\""))),
]

SENSITIVE_DATA = [
    Rule("SEN1", "sensitive_data", "HIGH", "CWE-532",
         "Sensitive Data Exposure — Logging Sensitive Field",
         r"(?i)(log|print|console\.log|fmt\.Print)\s*[\w.]*\s*[\(,+]\s*[^)]*\b(password|passwd|pwd|secret|token|api_key|credit_card|ssn|cvv|pin|auth)\b",
         "A credential-like field is written to a log or to the console, where others can read it.",
         "Leave the field out or mask it:\n  logger.info('login attempt by %s', username)",
         exts=LOG_FILES, needs=(("log", "print"), _CREDENTIALS, ("(", ",", "+"))),
    Rule("SEN2", "sensitive_data", "HIGH", "CWE-215",
         "Sensitive Data Exposure — DEBUG = True",
         r"\bDEBUG\s*=\s*True\b",
         "Debug mode shows stack traces, variables and settings to visitors.",
         "Take the switch from the environment:\n  DEBUG = os.environ.get('APP_DEBUG') == '1'",
         exts=PY, needs=(("=",), ("debug",), ("true",))),
    Rule("SEN3", "sensitive_data", "HIGH", "CWE-215",
         "Sensitive Data Exposure — Flask debug=True in app.run()",
         r"app\.run\s*\([^)]*debug\s*=\s*True",
         "The interactive debugger lets a visitor run code in the server process.",
         "Leave debug out of the call:\n  app.run(host=HOST, port=PORT)",
         exts=PY, needs=(("(",), ("app.run",), ("debug",))),
    Rule("SEN4", "sensitive_data", "HIGH", "CWE-16",
         "Security Misconfiguration — Django ALLOWED_HOSTS = []",
         r"ALLOWED_HOSTS\s*=\s*\[\s*\]",
         "An empty host list leaves the Host header unchecked once debug mode is off.",
         "Name the hosts that may be served:\n  ALLOWED_HOSTS = ['shop.example.org']",
         exts=PY, needs=(("=",), ("allowed_hosts",),)),
    Rule("SEN5", "sensitive_data", "CRITICAL", "CWE-798",
         "Sensitive Data Exposure — Weak or Default SECRET_KEY",
         r"""(?i)SECRET_KEY\s*=\s*['"](django-insecure|secret|changeme|dev|development|test|example|your[_-]?secret|[a-z]{5,30})['"]""",
         "The signing key is guessable, so sessions and reset links can be forged.",
         "Generate a long random key and read it at start-up:\n  SECRET_KEY = os.environ['APP_SECRET_KEY']",
         exts=PY, needs=(("=",), ("secret_key",),)),
    Rule("SEN6", "sensitive_data", "HIGH", "CWE-200",
         "Sensitive Data Exposure — Environment Variables in HTTP Response",
         r"(?i)(os\.environ|os\.getenv)\s*.*\b(jsonify|json\.dumps|Response|render)\b|\b(jsonify|json\.dumps|render)\s*\([^)]*os\.environ",
         "Environment values, often credentials, appear to be sent back to a client.",
         "Answer with explicit, harmless fields only.",
         exts=PY, needs=(("os.environ", "os.getenv"), ("jsonify", "json.dumps", "response", "render"))),
]

# Patterns that exist in the rule set but are switched off.
DISABLED = [
    Rule("OFF1", "command_injection", "HIGH", "CWE-78", "Template rendered from dynamic source (off)",
         r"(?i)(Environment|Template)\s*\(.*?\).*?render|jinja2\.Template\s*\(", exts=PY, enabled=False),
    Rule("OFF2", "xss", "HIGH", "CWE-79", "format_html with percent formatting (off)",
         r"\bformat_html\s*\([^)]*%[sd]", exts=PY, enabled=False),
    Rule("OFF3", "xss", "HIGH", "CWE-79", "outerHTML assignment (off)",
         r"""\.outerHTML\s*=(\s|[^=\s'"`]|$)""", exts=WEB, enabled=False),
    Rule("OFF4", "path_traversal", "MEDIUM", "CWE-22", "open() with a variable (off)",
         r"""\bopen\s*\(\s*(?!['"](?!\s*['"]))[^"'][^)]*\)""", exts=PY, enabled=False),
    Rule("OFF5", "sensitive_data", "MEDIUM", "CWE-209", "Stack trace in response (off)",
         r"(?i)(traceback|stack.?trace|exception|error)\b.*\b(response|jsonify|json\.dumps|return)\b|\b(jsonify|json\.dumps)\s*\([^)]*\b(traceback|exception|error|stack)\b",
         exts=LOG_FILES, enabled=False),
    Rule("OFF6", "sensitive_data", "MEDIUM", "CWE-209", "Internal detail in raised error (off)",
         r"(?i)(raise|except.*Exception).*\b(traceback\.format_exc|__file__|sys\.path|os\.environ)\b",
         exts=PY, enabled=False),
    Rule("OFF7", "weak_crypto", "HIGH", "CWE-327", "Password hashed with MD5 (off)",
         r"(?i)(password|passwd|pwd).*md5|md5.*(password|passwd|pwd)", exts=PY, enabled=False),
]

LANGUAGE_RULES = [*SQL_INJECTION, *COMMAND_INJECTION, *XSS, *PATH_TRAVERSAL,
                  *DESERIALIZATION, *WEAK_CRYPTO, *SENSITIVE_DATA]
