"""Inputs that Spark derives from the given tables, row by row.

The given tables hold no source code, manifests or advisories, so those corpora are made from
their rows: every row of a table becomes one file, package or record.  Each derived table is
written once, as expressions that render both as Spark columns and as SQL text, so that a check
in another engine starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.functions.text import string_array
from grainsieve.session import spread


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass
class Expr:
    """One expression in both spellings."""

    column: Callable[[], Column]
    sql: str


def raw(text: str) -> Expr:
    """Arithmetic or casts that both dialects spell alike."""
    return Expr(lambda: F.expr(text), f"({text})")


def text(value: str) -> Expr:
    return Expr(lambda: F.lit(value), quote(value))


def string(expr: str) -> Expr:
    return Expr(lambda: F.expr(expr).cast("string"), f"CAST({expr} AS VARCHAR)")


def pick(items, index: str) -> Expr:
    """Element ``index`` (0-based) of a fixed list."""
    items = list(items)
    return Expr(
        lambda: F.element_at(string_array(items), F.expr(f"CAST({index} + 1 AS INT)")),
        "[" + ", ".join(quote(i) for i in items) + f"][({index}) + 1]",
    )


def join(*parts) -> Expr:
    parts = [text(p) if isinstance(p, str) else p for p in parts]
    return Expr(lambda: F.concat(*[p.column() for p in parts]), "(" + " || ".join(p.sql for p in parts) + ")")


def fill(template: Expr, **values: Expr) -> Expr:
    """Replace ``#NAME#`` marks."""
    def column() -> Column:
        c = template.column()
        for name, v in values.items():
            c = F.replace(c, F.lit(f"#{name}#"), v.column())
        return c

    sql = template.sql
    for name, v in values.items():
        sql = f"replace({sql}, '#{name}#', {v.sql})"
    return Expr(column, sql)


def split(e: Expr, sep: str) -> Expr:
    """A text as a list (the separator is one plain character)."""
    return Expr(lambda: F.split(e.column(), f"[{sep}]", -1), f"string_split({e.sql}, {quote(sep)})")


@dataclass
class Derived:
    """A derived table: base table, columns."""

    base: str
    columns: dict[str, Expr]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        row = F.struct(*[e.column().alias(n) for n, e in self.columns.items()])
        # one generated row per input row: later steps read the finished values, instead of
        # having the optimizer paste these long expressions wherever a column is used
        return spread(table(spark, folder, self.base)).select(F.inline(F.array(row)))

    @property
    def sql(self) -> str:
        return "SELECT " + ", ".join(f'{e.sql} AS "{n}"' for n, e in self.columns.items()) + f" FROM {self.base}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- source files, one per event ------------------------------------------------------------

JS_LINES = (
    "const a#U# = req.query.name;",
    "let b#U# = \"fixed\" + 'text';",
    "const payload = JSON.parse(input#U#);",
    "var key = names[#U#];",
    "obj[key] = value#U#;",
    "if (key === '__proto__') { return; }",
    "store[payload] = a#U# + 1;",
    "sanitizer.bypassSecurityTrustResourceUrl(url#U#);",
    "this.san.bypassSecurityTrustHtml(html);",
    "x.bypassSecurityTrustUrl(u)",
    "child_process.exec(cmd#U#, done);",
    "child_process.spawn('ls -la');",
    "res.cookie('sid', v#U#, {\n  secure: false });",
    "eval(userInput#U#); // run",
    "eval(\"use strict\");",
    "  // scanner-disable-next-line JS-EVAL-EXEC",
    "eval(a#U# + b#U#); // scanner-disable-line",
    "eval(code); // scanner-expected JS-EVAL-EXEC, OTHER-RULE",
    "/* scanner-disable-line DOM-XSS-DOCUMENT-WRITE */ document.write(m#U#);",
    "const s = \"scanner-disable-line\"; eval(s#U#);",
    "eval(q#U#); // scanner-disable-line legacy code",
    "const f = new Function('return ' + a#U#);",
    "document.write(a#U#);",
    "el.innerHTML = b#U#.trim();",
    "el#U#.innerHTML = \"<b>\" + name;",
    "node.insertAdjacentHTML('beforeend', encodeURIComponent(a#U#));",
    "app.use(csurf({ ignoreMethods: ['GET', 'POST'] }));",
    "app.use(session({ secret: 's#U#',\n  cookie: { httpOnly: false, sameSite: 'none' } }));",
    "app.use(session({ resave: true, saveUninitialized: true, cookie: { secure: false } }));",
    "headers = { 'Authorization': 'Bearer abc#U#' };",
    "crypto.createHash('md5').update(x#U#);",
    "Object.assign(target#U#, source);",
    "const token#U# = Math.random().toString(36).slice(2);",
    "jwt.decode(t#U#);",
    "jwt.verify(t, k, { algorithms: ['none'], ignoreExpiration: true });",
    "images: { dangerouslyAllowSVG: true, hostname: '*' },",
    "process.env.NODE_TLS_REJECT_UNAUTHORIZED = '0';",
    "find({ '$where': fn#U# });",
    "a.href = location.hash;",
    "window.location = '/home#U#';",
    "res.redirect(req.query.next);",
    "window.open(target#U#, '_blank');",
    "fs.readFile(path.join(base, name#U#), 'utf8');",
    "res.sendFile(file#U#);",
    "const pem = '-----BEGIN RSA PRIVATE KEY-----';",
    "cfg[a#U#][b] = c;",
    "'use server';",
    "<a href=\"javascript:go(#U#)\">x</a>",
    "execa(cmd#U#); $(sel); shelljs.exec(c);",
    "db.query(`SELECT * FROM t WHERE id = ${id#U#}`);",
    "pool.execute(sql#U#, [1]); cache.query(sql);",
    "axios.get(url#U#); fetch(u, { m: 1 }); https.get(h);",
    "setTimeout('run()', #U#); setInterval(fn, 1);",
    "Handlebars.compile(tpl#U#); vm.runInContext(c); new vm.Script(z);",
    "agent = { rejectUnauthorized: false };",
    "v8.deserialize(buf#U#); yaml.load(doc);",
    "const st = { ...userData, x: #U# };",
    "return h('div', { class: 'c',\n innerHTML: raw#U# });",
    "<p dangerouslySetInnerHTML={{ __html: body#U# }} />",
    "// contact_email, phoneNumber and ssn of café émail user #U#",
    "const cfg = { api_key: k, password: p, address_line-2: '1.2.#U#.4' };",
    "send('user#U#@example.org', '123-45-6789', 'aa:bb:cc:dd:ee:ff');",
    "var iban = 'DE89370400440532013000', jwt = 'eyJhbGciOi.eyJzdWIi.c2ln';",
    "",
)
OTHER_LINES = {
    "py": (
        "import pickle, hashlib", "data = pickle.loads(blob#U#)", "h = hashlib.md5(x#U#)", "eval(expr#U#)",
        "requests.get(url,\n    verify=False)", "subprocess.run(cmd#U#, shell=True)", "yaml.load(f)",
        "CSRF_COOKIE_SECURE = False", "@csrf_exempt", "app.config.WTF_CSRF_ENABLED = False  # scanner-expected",
        "eval(x)  # scanner-disable-line PYTHON-EVAL-EXEC",
    ),
    "go": (
        "h := md5.New()", "exec.Command(\"sh\", \"-c\", cmd#U#)", "cfg := &tls.Config{\n\tInsecureSkipVerify: true}",
        "s := sha1.New() // x#U#", "fmt.Println(\"ok\")",
    ),
    "rs": (
        "Command::new(\"sh\").arg(\"-c\").arg(cmd)\n  .output();", "let d = md5::compute(b#U#);",
        "reqwest::Client::builder()\n  .danger_accept_invalid_certs(true).build()", "fn main() {}",
    ),
    "java": (
        "conn.setHostnameVerifier((h, s) -> true);", "MessageDigest.getInstance(\"MD5\");",
        "Runtime.getRuntime().exec(cmd#U#);", "http.csrf()\n  .disable();", "int x = #U#;",
    ),
    "php": (
        "curl_setopt($ch, CURLOPT_SSL_VERIFYPEER, false);", "eval($code#U#);", "$h = md5($x) . sha1($y);", "echo 1;",
    ),
    "rb": (
        "Digest::MD5.hexdigest(s#U#)", "OpenSSL::SSL::VERIFY_NONE", "system(\"ls #U#\")", "YAML.load(doc)",
        "protect_from_forgery with: :null_session", "skip_before_action :verify_authenticity_token",
    ),
    "cs": ("var h = MD5.Create();", "Process.Start(cmd#U#);", "[IgnoreAntiforgeryToken]", "SHA1.Create();"),
    "sh": ("curl -s -k https://x#U#", "wget --no-check-certificate $u", "cat f | md5sum", "sha1sum f#U#"),
    "yaml": ("privileged: true", "  insecureSkipTlsVerify: true", "verify: false", "name: n#U#"),
}
_EXTENSIONS = ("js", "ts", "js", "py", "jsx", "go", "mjs", "rs", "js", "java", "tsx", "php", "js", "rb", "cjs", "cs", "sh", "js", "yaml")
_DIRS = ("src", "lib", "app/core", "src/api", "web")


def _code_line(k: int) -> Expr:
    """Line ``k`` of an event's file, from the list of the file's language."""
    mix = f"event_id * {2 * k + 3} + user_id * {k + 1}"
    js = pick(JS_LINES, f"({mix}) % {len(JS_LINES)}")
    groups = {e: pick(v, f"({mix}) % {len(v)}") for e, v in OTHER_LINES.items()}
    kind = pick(_EXTENSIONS, f"event_id % {len(_EXTENSIONS)}")

    def column() -> Column:
        # the lines of all lists in one: a language's list is a stretch of it
        lists = {"": JS_LINES, **OTHER_LINES}
        sizes = [len(lists.get(e, JS_LINES)) for e in _EXTENSIONS]
        begins = {e: sum(len(v) for v in list(lists.values())[:i]) for i, e in enumerate(lists)}
        number = lambda values: F.element_at(string_array(map(str, values)).cast("array<int>"), F.expr(f"CAST(event_id % {len(_EXTENSIONS)} + 1 AS INT)"))
        size, left = number(sizes), F.expr(mix) % number(sizes)
        # a place below zero counts from the end of its list
        at = F.when(left >= 0, left).otherwise(left + size + 1).cast("int") + number(begins.get(e, 0) for e in _EXTENSIONS) + 1
        return F.element_at(string_array(x for v in lists.values() for x in v), at)

    sql = f"CASE {kind.sql} " + " ".join(f"WHEN {quote(e)} THEN {g.sql}" for e, g in groups.items()) + f" ELSE {js.sql} END"
    return fill(Expr(column, sql), U=string("user_id"))


CODE_FILES = Derived("events", {
    "path": join(pick(_DIRS, f"event_id % {len(_DIRS)}"), "/f", string("event_id"), ".", pick(_EXTENSIONS, f"event_id % {len(_EXTENSIONS)}")),
    "text": join(*[p for k in range(6) for p in (_code_line(k), "\n")]),
})

# Paths with test, vendored, hidden and odd shapes, one per event.
_PATH_SHAPES = (
    "src/a#U#.js", "src/a#U#.test.js", "pkg/__tests__/a.js", "node_modules/lib#U#/v.js", "dist/bundle.min.js",
    "types/x#U#.d.ts", "a.spec.ts", "SRC/UPPER#U#.JS", "Makefile", ".env", "conf/app#U#.ini", "e2e/login.py",
    "x/Build/y#U#.go", "build/y.go", "docs/readme#U#.md", "a/b/.git/config.yaml", "cypress/x.rb", "deep/.next/z.rs",
    "vendor", "q/archive.tar.gz", "data#U#.csv", "s/#U#.zsh", "v/outer/p.php", "Playwright/t#U#.cs",
)
PATHS = Derived("events", {
    "path": fill(pick(_PATH_SHAPES, f"event_id % {len(_PATH_SHAPES)}"), U=string("event_id")),
})
LANGUAGE_NAMES = Derived("orders", {
    "o_orderkey": raw("o_orderkey"),
    "name": pick(("", " JS", "typescript", "GoLang", "c#", "C-Sharp", "shell", " yml ", "Rust", "cobol", "Kotlin ", "rb", "py", "PHP", "java"),
                 "o_orderkey % 15"),
})

# --- findings, one per order ----------------------------------------------------------------

FINDINGS = Derived("orders", {
    "kind": pick(("code", "", " Code ", "dependency", "code", "DEPENDENCY"), "o_orderkey % 6"),
    "file": join("src/m", string("o_custkey"), "/f", string("o_orderkey % 40"), ".js"),
    "line": raw("CAST(o_orderkey % 500 AS INT)"),
    "column": raw("CAST(o_custkey % 80 AS INT)"),
    "end_line": raw("CAST(o_orderkey % 500 + o_custkey % 2 AS INT)"),
    "end_column": raw("CAST(o_custkey % 80 + 5 AS INT)"),
    "rule_id": pick(("JS-EVAL-EXEC", "XSS-01", "SQL-RAW-QUERY", "NO-SUCH-RULE", "GO-INSECURE-HASH"), "o_custkey % 5"),
    "severity": pick(("HIGH", "low", "CRITICAL", "MEDIUM", "BOGUS", ""), "o_orderkey % 6"),
    "framework": pick(("React", "", "Node.js", "JavaScript", "Vue"), "(o_orderkey + o_custkey) % 5"),
    "snippet": fill(pick(("eval(x#K#)", "", "  y = 1 ", "a & <b> \"q\""), "o_orderkey % 4"), K=string("o_custkey")),
    "matched_code": fill(pick(("eval(x#K#)", "y = 1", ""), "o_orderkey % 3"), K=string("o_custkey")),
    "highlighted_snippet": text("h"),
    "confidence": pick(("HIGH", "", "low", " medium "), "o_orderkey % 4"),
    "tags": split(pick(("csrf", "secrets|data", "a| |b"), "o_orderkey % 3"), "|"),
    "description": text("d"),
    "category": pick(("Injection", "", " Secrets Exposure ", "Privacy Risk", "injection"), "o_orderkey % 5"),
    "taxonomy": split(text("t1|t2"), "|"),
    "cwe": split(pick(("CWE-79", "CWE-89|CWE-20"), "o_orderkey % 2"), "|"),
    "owasp": split(text("A03:2021"), "|"),
    "references": split(text("r1|r2"), "|"),
    "remediation": text("fix"),
    "confidence_rationale": text(""),
    "package_name": text(""),
    "declared_version": text(""),
    "resolved_version": text(""),
    "version_source": text(""),
    "fixed_versions": split(text("1.0|2.0"), "|"),
    "project_path": text(""),
    "fingerprint": fill(pick(("", "fp#K#", " fp#K# ", "fp#K#", "  "), "o_orderkey % 5"), K=string("o_custkey % 700")),
})
BASELINE_DOCS = Derived("customer", {
    "value": fill(
        pick(("{\"version\": 1, \"fingerprints\": [\"fp#K#\", \" fp#K# \", \"\"]}", "[\"fp#K#\", \"x#K#\"]", "", "{\"version\": 2}"), "c_custkey % 4"),
        K=string("c_custkey"),
    ),
})
CHANGED_LINES = Derived("events", {
    "value": fill(pick(("src/f#K#.js", "  lib/f#K#.ts ", "", "# note #K#", "/abs/./x/../f#K#.py", "app/core/f#K#.js"), "event_id % 6"), K=string("event_id")),
})
EXCLUDED = Derived("supplier", {
    "path": fill(pick(("src/f#K#.js", " lib/ ", "", "web/f#K#.js", "app"), "s_suppkey % 5"), K=string("s_suppkey")),
})

# --- rules ----------------------------------------------------------------------------------

NATIVE_RULES = Derived("part", {
    "id": join(" R-", string("p_partkey"), " "),
    "language": pick(("", "JS", "Python", "c#", " Shell ", "cobol"), "p_partkey % 6"),
    "confidence": pick(("", "high", "Low", "MEDIUM"), "p_partkey % 4"),
    "description": pick(("about", "", "  "), "p_partkey % 3"),
    "message": pick(("", " said ", ""), "p_size % 3"),
    "tags": split(pick(("csrf", "a| b |", " | "), "p_partkey % 3"), "|"),
    "requires_dependency": split(pick(("react", "pkg#1|pkg#2", "vue|nuxt"), "p_size % 3"), "|"),
})
BUNDLE_RULES = Derived("part", {
    "id": pick(("r1", " r2 ", "", "r4"), "p_partkey % 4"),
    "part": string("p_partkey"),
    "severity": pick(("ERROR", "warning", "INFO", "high", "odd", ""), "p_partkey % 6"),
    "message": pick(("", " said "), "p_partkey % 2"),
    "query": pick(("", "eval[(]", "((", " exec "), "p_size % 4"),
    "metadata_query": pick(("", "meta.x"), "p_partkey % 2"),
    "metadata_framework": pick(("", "React", "go", " Vue "), "p_size % 4"),
    "metadata_description": pick(("", "about"), "p_size % 2"),
    "pattern_either": split(pick(("((|either1", "either2"), "p_partkey % 2"), "|"),
    "patterns": split(text("p1|p2"), "|"),
    "languages": split(pick(("ts", "react|go", "cobol|python", "nodejs", ""), "p_partkey % 5"), "|"),
})

# --- packages and intel ---------------------------------------------------------------------

_NAMES = ("lodash", "next", "react", "react-dom", "vue", "pinia", "nuxt", "express", "@angular/core", "left-pad")
_VERSION = join(string("l_linenumber"), ".", string("l_partkey % 9"), ".", string("l_suppkey % 7"))
PACKAGES = Derived("lineitem", {
    "ecosystem": pick(("npm", "npm", "npm", "pip", "go", "cargo"), "l_partkey % 6"),
    "project_path": join("proj/", string("l_suppkey")),
    "manifest_path": join("proj/", string("l_suppkey"), "/", pick(("package.json", "package.json", "package.json", "requirements.txt", "go.mod", "Cargo.toml"), "l_partkey % 6")),
    "scope": pick(("dependencies", "devDependencies", "dependencies"), "l_partkey % 3"),
    "package": fill(pick(_NAMES + ("pkg-#P#",) * 30, "l_partkey % 40"), P=string("l_partkey % 1000")),
    "declared_version": join(pick(("", "^", "v", "~", ""), "l_orderkey % 5"), _VERSION, pick(("", "", "-beta.2", ""), "l_orderkey % 4")),
    "resolved_version": pick(("", "2.3.1", "", "1.0.0-rc.1"), "l_orderkey % 4"),
    "version_source": pick(("", "package-lock.json", "", "pnpm-lock.yaml"), "l_orderkey % 4"),
    "relationship": pick(("direct", "transitive", "direct"), "l_orderkey % 3"),
    "dependency_path": join("root>", string("l_orderkey % 11")),
})
_CONSTRAINTS = (
    "<#A#.4.0", ">=#A#.0.0 <#A#.5.2", ">#A#.1.1|<0.2.0", "=#A#.2.3", ">= #A#.0.0-beta.1 < #A#.3.0", "<=#A#.2.2|>=6.0.0",
)
ADVISORIES_A = Derived("part", {
    "id": join("ADV-", string("p_partkey")),
    "ecosystem": pick(("npm", "npm", "npm", "pip", "go", "cargo"), "p_partkey % 6"),
    "package": fill(pick(_NAMES + ("pkg-#P#",) * 190, "p_partkey % 200"), P=string("p_partkey % 1000")),
    "severity": pick(("HIGH", "CRITICAL", "MEDIUM", "LOW", "high"), "p_size % 5"),
    "title": join("Issue ", string("p_partkey")),
    "description": join("About ", string("p_size")),
    "affected_versions": split(fill(pick(_CONSTRAINTS, f"p_partkey % {len(_CONSTRAINTS)}"), A=string("p_size % 7")), "|"),
    "fixed_version": pick(("", "4.0.0", "5.2.0"), "p_partkey % 3"),
    "aliases": split(join("CVE-", string("p_partkey"), "|GHSA-", string("p_size")), "|"),
    "cwe": split(pick(("CWE-1321", "CWE-20|CWE-79"), "p_partkey % 2"), "|"),
    "source": text("seed"),
    "references": split(text("ref1|ref2"), "|"),
})
ADVISORIES_B = Derived("supplier", {
    "id": join("CVE-B-", string("s_suppkey")),
    "title": text("B"),
    "severity": pick(("CRITICAL", "LOW"), "s_suppkey % 2"),
    "description": text("shape b"),
    "aliases": split(join("GHSA-B-", string("s_suppkey")), "|"),
    "references": split(text("rb"), "|"),
    "_package": pick(_NAMES, "s_suppkey % 10"),
    "_ranges": fill(pick(("#A#.0.0,#A#.0.4|#A#.1.0,#A#.2.2", ",#A#.3.0", "#A#.5.0,"), "s_suppkey % 3"), A=string("s_suppkey % 8")),
})
COMPROMISED = Derived("part", {
    "id": join("COMP-", string("p_partkey")),
    "ecosystem": pick(("npm", "Rust", "pip"), "p_partkey % 3"),
    "package": fill(pick(_NAMES + ("pkg-#P#",) * 30, "p_partkey % 40"), P=string("p_partkey % 1000")),
    "severity": pick(("CRITICAL", "HIGH"), "p_partkey % 2"),
    "description": join("bad ", string("p_partkey")),
    "source": text("curated"),
    "versions": split(join(string("p_size % 7"), ".", string("p_partkey % 9"), ".3|v", string("p_size % 7 + 1"), ".2.1"), "|"),
    "_ioc_types": split(text("domain|ip"), "|"),
    "_ioc_values": split(join("d", string("p_partkey"), ".example|10.0.0.", string("p_size")), "|"),
})
POLICY = Derived("part", {
    "id": join("ADV-", string("p_partkey * 3")),
    "package": pick(("", "lodash", "next", "pkg-3"), "p_partkey % 4"),
    "expiry": pick(("", "2024-06-01 00:00:00", "2030-01-01 00:00:00", "2025-01-01 00:00:00"), "p_size % 4"),
})
VERSION_LIST = Derived("lineitem", {"version": join(pick(("", "v", ""), "l_partkey % 3"), _VERSION, pick(
    ("", "-alpha", "-alpha.1", "-2", "+build.5", "-rc.10", "-rc.9"), "l_orderkey % 7"))})

# --- manifests, five per customer -----------------------------------------------------------

_K = dict(K=string("c_custkey"), N=string("c_nationkey"))
_MANIFESTS = {
    "package.json": "{\"name\": \"p#K#\", \"dependencies\": {\"next\": \"^1.#N#.0\", \"lib-#K#\": \"2.#N#.1\"}, \"devDependencies\": {\"vite\": \"~6.#N#.2\"}}",
    "package-lock.json": "{\"packages\": {\"\": {\"version\": \"0\"}, \"node_modules/next\": {\"version\": \"1.#N#.7\"}, \"node_modules/a/node_modules/next\": {\"version\": \"9.9.9\"}, \"node_modules/@s/u\": {\"version\": \"3.#N#.0\"}}}",
    "requirements.txt": "# pins\nflask==1.#N#.0\nrequests[socks]>=2.#N#  # why\n\n-r other.txt\nnumpy ~= 1.#N#\nbare-#K#\n",
    "go.mod": "module example.org/m#K#\n\ngo 1.21\n\nrequire (\n\tgithub.com/a/b#K# v1.#N#.0\n\tgolang.org/x/net v0.#N#.1 // indirect\n)\nrequire gopkg.in/yaml.v3 v3.0.#N#\nreplace github.com/a/b => github.com/c/d v9.0.0\n",
    "Cargo.toml": "[package]\nname = \"c#K#\"\nversion = \"0.1.0\"\n\n[dependencies]\nserde = \"1.#N#\"\ntokio = { version = \"1.#N#.2\", features = [\"full\"] }\n\n[dev-dependencies]\nrand = \"0.#N#\"\n",
    "pnpm-lock.yaml": "lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n    dependencies:\n      lib-#K#:\n        specifier: 2.#N#.1\n        version: 2.#N#.1\n    devDependencies:\n      vite:\n        specifier: ~6.#N#.2\n        version: 6.#N#.9(x@1)\n",
}
MANIFEST_TABLES = {
    name: Derived("customer", {
        "path": join("proj/c", string("c_custkey"), "/", name),
        "text": fill(text(body), **_K),
    })
    for name, body in _MANIFESTS.items()
}

#: Forms that ordinary manifests have besides those above: tables of their own, targets, renames; replacements.
_MORE_MANIFESTS = {
    "Cargo.toml": "[package]\nname = \"c#K#\"\nversion = \"0.1.0\"\n\n[dependencies.tokio]\nversion = \"1.#N#\"\nfeatures = [\"full\"]\n\n[target.'cfg(unix)'.dependencies]\nnix = \"0.#N#\"\n"
    "old = { version = \"2.#N#\", package = \"renamed-#K#\" }\n\n[target.x86_64-pc-windows-gnu.dev-dependencies.winapi]\npackage = 'winapi-real'\nversion = '0.3.#N#'\n\n[build-dependencies.\"cc\"]\npath = \"../cc\"\n\n[features]\nx = \"1\"\n",
    "go.mod": "module example.org/m#K#\n\nrequire (\n\tgithub.com/a/b v1.#N#.0\n\tgithub.com/c/d v2.0.#N# // indirect\n\tgolang.org/x/net v0.#N#.1\n)\nrequire gopkg.in/yaml.v3 v3.0.#N#\n"
    "replace github.com/a/b => github.com/fork/b v9.0.#N#\nreplace (\n\tgithub.com/c/d v2.0.3 => github.com/fork/d v2.0.4\n\tgithub.com/c/d => ../local/d\n\tgolang.org/x/net v9.9.9 => golang.org/x/net v9.9.10\n)\n",
}
MORE_MANIFESTS = {
    name: Derived("customer", {"path": join("more/c", string("c_custkey"), "/", name), "text": fill(text(body), **_K)}) for name, body in _MORE_MANIFESTS.items()
}

# --- lock files as graphs -------------------------------------------------------------------

#: Nested copies, a cycle and two versions of one package; workspaces that link to each other; the older, nested format; no JSON.
_LOCK_GRAPHS = (
    "{\"lockfileVersion\": 3, \"packages\": {\"\": {\"name\": \"p#K#\", \"dependencies\": {\"express\": \"^4.#N#.0\", \"qs\": \"6.5.2\"}, \"devDependencies\": {\"vite\": \"~6.#N#.2\"}}, "
    "\"node_modules/express\": {\"version\": \"4.#N#.1\", \"dependencies\": {\"qs\": \"6.5.1\", \"a\": \"^1.0.0\"}}, \"node_modules/express/node_modules/qs\": {\"version\": \"6.5.1\", \"dependencies\": {\"side\": \"1\", \"gone\": \"1\"}}, "
    "\"node_modules/qs\": {\"version\": \"6.5.2\", \"dependencies\": {\"side\": \"1.#N#.0\"}}, \"node_modules/side\": {\"version\": \"1.#N#.0\"}, "
    "\"node_modules/a\": {\"version\": \"1.0.#N#\", \"dependencies\": {\"b\": \"1.x\"}}, \"node_modules/b\": {\"version\": \"1.2.#N#\", \"dependencies\": {\"a\": \"^1.0.0\", \"@s/u\": \"*\"}, \"optionalDependencies\": {\"fsevents\": \"2\"}}, "
    "\"node_modules/@s/u\": {\"version\": \"3.#N#.0\", \"peerDependencies\": {\"express\": \"*\"}}, \"node_modules/vite\": {\"version\": \"6.#N#.9\", \"dev\": true, \"dependencies\": {\"b\": \"1.x\", \"rollup\": \"4\"}}, "
    "\"node_modules/rollup\": {\"version\": \"4.#N#.0\", \"dev\": true, \"dependencies\": {\"qs\": \"6\"}}, \"node_modules/orphan\": {\"version\": \"0.0.1\"}}}",
    "{\"lockfileVersion\": 3, \"packages\": {\"\": {\"name\": \"mono#K#\", \"dependencies\": {\"app\": \"*\"}}, \"packages/app\": {\"name\": \"app\", \"version\": \"0.#N#.0\", \"dependencies\": {\"lib\": \"*\", \"qs\": \"6\"}}, "
    "\"packages/lib\": {\"dependencies\": {\"app\": \"*\", \"qs\": \"5\"}, \"devDependencies\": {\"tap\": \"1\"}}, \"packages/lib/node_modules/qs\": {\"version\": \"5.#N#.0\"}, \"node_modules/app\": {\"link\": true, \"resolved\": \"packages/app\"}, "
    "\"node_modules/lib\": {\"link\": true, \"resolved\": \"packages/lib\"}, \"node_modules/qs\": {\"version\": \"6.#N#.1\", \"dependencies\": {\"side\": \"2\"}}, \"node_modules/side\": {\"version\": \"2.0.0\"}, \"node_modules/tap\": {\"version\": \"1.0.0\"}}}",
    "{\"lockfileVersion\": 1, \"requires\": true, \"dependencies\": {\"next\": {\"version\": \"1.#N#.7\", \"requires\": {\"c\": \"2\", \"d\": \"1\"}, \"dependencies\": {\"c\": {\"version\": \"2.0.#N#\", \"requires\": {\"d\": \"2\"}, "
    "\"dependencies\": {\"d\": {\"version\": \"2.2.2\"}}}}}, \"c\": {\"version\": \"1.0.0\", \"requires\": {\"next\": \"*\"}}, \"d\": {\"version\": \"1.1.1\", \"requires\": {\"c\": \"1\"}}, \"vite\": {\"version\": \"6.#N#.1\", \"dev\": true}}}",
    "not json #K#",
)
LOCK_GRAPHS = Derived("customer", {
    "path": join("locks/c", string("c_custkey"), "/", pick(("package-lock.json", "package-lock.json", "npm-shrinkwrap.json", "package-lock.json"), "c_custkey % 4")),
    "text": fill(pick(_LOCK_GRAPHS, "c_custkey % 4"), **_K),
})
LOCK_PROJECTS = Derived("customer", {
    "path": join("locks/c", string("c_custkey"), "/package.json"),
    "text": fill(pick((
        "{\"dependencies\": {\"express\": \"^4.#N#.0\", \"qs\": \"6.5.2\"}, \"devDependencies\": {\"vite\": \"~6.#N#.2\"}}", "{\"dependencies\": {\"app\": \"*\"}}",
        "{\"dependencies\": {\"next\": \"^1.#N#.0\"}, \"devDependencies\": {\"vite\": \"6\", \"none\": \"1\"}}", "{\"dependencies\": {\"x\": \"1.0.0\"}}"), "c_custkey % 4"), **_K),
})

# --- pages with external scripts, resources -------------------------------------------------

_TAGS = (
    "<script src=\"/js/app#K#.js\"></script><script src='lib/../vendor/./x.mjs?v=1&amp;w=2'></script>",
    "<SCRIPT TYPE=\"application/json\">{\"a\":1}</SCRIPT><script src=\"//cdn.example.org/x.js\"></script>",
    "<script type=' Module ' src=\"a b#K#.js\"></script><script src=\"data:text/javascript,1\"></script><script>  </script>",
    "<!-- <script src=\"/hidden.js\"></script> --><script src=\"?q=#K#\">ignored()</script><script src=/plain.js></script>",
    "<script src=\"/js/same.js\"></script><script src=\"/other/same.js\"></script><script src=\"/js/same.js#f\"></script>",
    "<script data-src=\"/no.js\">inline#K#();</script><script src=\"../../up/%2e%2e/%C3%A9.js\"></script>",
    "<script><!-- hidden#K#(); //--></script><script>var a = '<!--';</script><script src=\"/after.js\"></script><!-- x -->",
    "<script src=\"/\"></script><script src=\"/dir/\"></script><script src=\"/bad%zz.js\"></script>",
    "<textarea><script src=\"/no-text.js\"></script></textarea><TITLE>a <script>no#K#()</script></TITLE><script src=\"/q.js?a=1&#x26;b=&#50;&amp;#51;&#38;lt;&apos;&nbsp;&#0;&#x1F600;&bogus;\"></script>",
    "<style>.a { content: '<script>no()</script>' }</style><script src='/&#x2f;&#47;x#K#.js'></script><script>open#K#(); // never closed",
)
PAGES = Derived("pages", {
    "page_id": raw("page_id"),
    "url": raw("url"),
    "html": join(raw("html"), fill(pick(_TAGS, f"page_id % {len(_TAGS)}"), K=string("page_id"))),
})
_VARS = ("a", "b", "c", "d", "e", "g", "h", "k", "m")
_TARGETS = ("#T#", "#T#", "#T#", "{ #T#, z: w }", "#T#.href", "o[#T#]", "[#T#, rest]", "#T#")
_EXPRS = (
    "req.body.x", "\"lit\" + 'q'", "#A#", "#A#", "#A# + #B#", "encodeURIComponent(#A#)", "#A#.trim()", "`v${#A#}-${#B#}`",
    "foo(#A#)", "DOMPurify.sanitize(#A#)", "#A#.length", "req['x']", "localStorage.getItem('k')", "(#A# + 'x')",
    "{ k: #A#, #B# }", "#A# ? #B# : 1", "-1", "!#A#", "params.get(\"id\").toLowerCase()", "new Thing(#A#)", "await #A#",
    "#A# === #B#", "/re+/g", "x => #A#", "validator.escape(#A#).trim()", "#A#[0].name", "he.encode(a, b) + #B#", "#B#",
    "`plain`", "typeof #A#", "req", "window.name || #B#",
)
_STATEMENT_FILE = Expr(
    lambda: F.concat(F.lit("f"), F.floor(F.col("event_id") / 60).cast("string")), "('f' || CAST(event_id // 60 AS VARCHAR))"
)
STATEMENTS = Derived("events", {
    "file": _STATEMENT_FILE,
    "pos": raw("event_id"),
    "target": fill(pick(_TARGETS, f"(event_id * 5 + user_id) % {len(_TARGETS)}"), T=pick(_VARS, "(event_id * 7 + user_id) % 9")),
    "expr": fill(
        pick(_EXPRS, f"(event_id * 11 + user_id * 3) % {len(_EXPRS)}"),
        A=pick(_VARS, "(event_id * 4 + user_id) % 9"), B=pick(_VARS, "(event_id * 2 + user_id * 5) % 9"),
    ),
})
#: Nested, mixed and unbalanced brackets, and brackets in texts.
_ARGUMENTS = (
    "#A#, f(g([1, 2], {k: [3, (4, 5)]}), 6)", "([#A#), #B#", "#A#], #B#", "f(#A#, #B#", "{[(#A#, 1)], 2}, #B#", "'(', #A#, \"]\", `{`", "((((#A#, 1), 2), 3), 4), #B#",
    "", " , #A#,, ", "[#A#, (1, 2], 3), #B#", "(#A#}, 1), #B#", "}{, #A#", "f(#A#)(#B#, 2)[3, 4], 5",
)
ARGUMENTS = Derived("events", {
    "event_id": raw("event_id"),
    "args": fill(pick(_ARGUMENTS, f"(event_id + user_id) % {len(_ARGUMENTS)}"), A=pick(_VARS, "(event_id * 5 + 1) % 9"), B=string("event_id")),
})
_SINKS = ("#A#", "#A#, 'x'", "\"lit\", #A#", "", "'a', 'b'", "encodeURI(#A#)", "req.query.q", "#A# + #B#", "foo(#A#), [#B#, 1]")
SINKS = Derived("events", {
    "sink_id": string("event_id"),
    "file": _STATEMENT_FILE,
    "rule_id": pick(("R-ANY", "R-PROVEN", "R-INDEX", "R-OFF", "R-PY"), "event_id % 5"),
    "expr": fill(pick(_SINKS, f"(event_id + user_id) % {len(_SINKS)}"), A=pick(_VARS, "(event_id * 5 + 1) % 9"), B=pick(_VARS, "(event_id * 2 + user_id) % 9")),
    "language": pick(("javascript", "javascript", "javascript", "javascript", "python"), "event_id % 5"),
    "require_tainted": Expr(lambda: F.expr("event_id % 5 != 3"), "(event_id % 5 != 3)"),
    "require_proven_tainted": Expr(lambda: F.expr("event_id % 5 = 1"), "(event_id % 5 = 1)"),
    "sink_arg_index": Expr(lambda: F.expr("CASE WHEN event_id % 5 = 2 THEN CAST(user_id % 3 AS INT) END"), "CASE WHEN event_id % 5 = 2 THEN CAST(user_id % 3 AS INT) END"),
    "is_args": Expr(lambda: F.expr("event_id % 2 = 0"), "(event_id % 2 = 0)"),
})
