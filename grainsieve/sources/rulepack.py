"""Built-in lexical rule pack.

Each block is one rule:  id | severity | framework | language | confidence | scope
  d  description            g  guard substrings (any one must occur)
  p  pattern                c  capture names ("*name": the finding is that capture, which must be
                               the last thing the pattern matches)
  o  options: literal=NAME, ignore=NAME:REGEX, require=NAME:REGEX, taint=NAME[,ARG_INDEX],
     dep=PKG,.., tags=..,  cwe=.., owasp=.., fix=TEXT, cat=CATEGORY (with cwe/owasp/fix in the
     metadata block), tax=..
``<ARG>`` in a pattern is one call argument, ``<GAP>`` a stretch of any length without ``;``.
"""

from __future__ import annotations

_ATOM = r"""(?:"[^"]*"|'[^']*'|`[^`]*`|\([^()]*(?:\([^()]*\)[^()]*)*\))"""
_PLAIN = r"""[^(),;"'`]"""
ARG = rf"""(?:{_ATOM}|[^\s(),;"'`]){_PLAIN}*(?:{_ATOM}{_PLAIN}*)*"""
GAP = r"[^;]*?"

# Rule ids, severities, frameworks, languages, confidences and classifications.
RULE_TEXT = r"""
ANGULAR-BYPASS-SECURITY-RESOURCE-URL | HIGH | Angular | JavaScript | | line
d Angular resource-URL sanitising is bypassed.
g bypassSecurityTrustResourceUrl
p [A-Za-z_$][\w$.]*\.bypassSecurityTrustResourceUrl\(
o dep=@angular/core
o cat=Cross-Site Scripting
o tax=code-pattern/framework
o cwe=CWE-79
o owasp=A03:2021
o fix=Check resource URLs against an allowlist first.

ANGULAR-BYPASS-SECURITY-TRUST-HTML | HIGH | Angular | JavaScript | | line
d Angular HTML sanitising is bypassed.
g bypassSecurityTrustHtml
p [A-Za-z_$][\w$.]*\.bypassSecurityTrustHtml\(
o dep=@angular/core
o cat=Cross-Site Scripting
o tax=code-pattern/framework
o cwe=CWE-79
o owasp=A03:2021
o fix=Keep the default sanitiser.

ANGULAR-BYPASS-SECURITY-TRUST-URL | HIGH | Angular | JavaScript | | line
d Angular URL sanitising is bypassed.
g bypassSecurityTrustUrl
p [A-Za-z_$][\w$.]*\.bypassSecurityTrustUrl\(
o dep=@angular/core
o cat=Open Redirect
o tax=code-pattern/framework
o cwe=CWE-601
o owasp=A01:2021
o fix=Use allowlisted URLs only.

ASPNET-IGNORE-ANTIFORGERY-TOKEN | HIGH | ASP.NET | C# | | line
d Antiforgery validation is switched off by attribute.
g IgnoreAntiforgeryToken
p \[\s*IgnoreAntiforgeryToken(?:Attribute)?\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Validate the antiforgery token.

BASH-CURL-INSECURE | HIGH | Bash | Bash | | line
d curl or wget without TLS verification.
g curl wget
p \b(curl)\b[^\n|;]*\s(-k|--insecure)\b|\b(wget)\b[^\n|;]*\s(--no-check-certificate)\b
c cmd flag cmd flag

BASH-WEAK-HASH-COMMAND | MEDIUM | Bash | Bash | | line
d md5sum or sha1sum is used.
g md5sum sha1sum
p (?:^|[;&|]\s*)(md5sum|sha1sum)\b
c cmd

NODE-CHILD-PROCESS-EXEC | CRITICAL | Node.js | JavaScript | HIGH | line
d A command is run through child_process.
g child_process
p \bchild_process\.(execSync|execFileSync|execFile|exec|spawnSync|spawn)\(\s*(<ARG>)
c method *cmd
o literal=cmd
o taint=cmd
o cat=Command Injection
o tax=code-pattern/framework
o cwe=CWE-78
o owasp=A03:2021
o fix=Use execFile or spawn with fixed arguments.

COOKIE-SECURE-FALSE | MEDIUM | Express | JavaScript | | file
d A cookie is set with secure:false.
g .cookie(
p \.cookie\(<GAP>\bsecure\s*:\s*false\b

CSHARP-INSECURE-HASH | MEDIUM | C# | C# | | line
d MD5 or SHA1 hash object.
g MD5.Create SHA1.Create
p \b(MD5|SHA1)\.Create\(
c obj

CSHARP-PROCESS-START | HIGH | C# | C# | | line
d A process is started.
g Process.Start
p \bProcess\.Start\(

JS-EVAL-EXEC | HIGH | JavaScript | JavaScript | HIGH | line
d eval() runs text as code.
g eval(
p \beval\(([^()]*(?:\([^()]*\)[^()]*)*)\)
c arg
o literal=arg

JS-FUNCTION-CONSTRUCTOR | HIGH | JavaScript | JavaScript | | line
d new Function() builds code from text.
g Function
p \bnew\s+Function\b

DJANGO-CSRF-COOKIE-SECURE-FALSE | MEDIUM | Django | Python | | line
d The CSRF cookie may travel over plain HTTP.
g CSRF_COOKIE_SECURE
p \bCSRF_COOKIE_SECURE\s*=\s*False\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A05:2021
o rfix=Set CSRF_COOKIE_SECURE to True.

DJANGO-CSRF-EXEMPT | HIGH | Django | Python | | line
d A view is exempt from CSRF checks.
g csrf_exempt
p @csrf_exempt\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Remove the decorator.

DOM-XSS-DOCUMENT-WRITE | HIGH | JavaScript | JavaScript | HIGH | line
d document.write() with dynamic text.
g document.write(
p \bdocument\.write\(\s*(<ARG>)
c *value
o taint=value

DOM-XSS-INNERHTML-ASSIGN | HIGH | JavaScript | JavaScript | HIGH | line
d innerHTML is assigned.
g .innerHTML
p \.innerHTML\s*=\s*([^=;\s][^;]*)
c *value
o literal=value
o taint=value

DOM-XSS-INSERT-ADJACENT-HTML | HIGH | JavaScript | JavaScript | HIGH | line
d insertAdjacentHTML() with dynamic text.
g insertAdjacentHTML
p \.insertAdjacentHTML\(\s*<ARG>,\s*(<ARG>)
c *html
o literal=html
o taint=html

EXPRESS-CSURF-IGNORE-STATE-CHANGING | HIGH | Express | JavaScript | | file
d csurf ignores state-changing methods.
g csurf(
p \bcsurf\(<GAP>\bignoreMethods\s*:\s*(\[[^\]]*["'](?:POST|PUT|PATCH|DELETE)["'][^\]]*\])
c methods
o ignore=methods:^\[\s*(?:["'](GET|HEAD|OPTIONS)["'](?:\s*,\s*)?)*\]$
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Only exempt GET, HEAD and OPTIONS.

EXPRESS-SESSION-HTTPONLY-FALSE | MEDIUM | Node.js | JavaScript | | file
d Session cookie with httpOnly:false.
g session(
p \bsession\(<GAP>\bcookie\s*:\s*\{[^{};]*?\bhttpOnly\s*:\s*false\b

EXPRESS-SESSION-RESAVE-TRUE | LOW | Express | JavaScript | | file
d Session with resave:true.
g session(
p \bsession\(<GAP>\bresave\s*:\s*true\b

EXPRESS-SESSION-SAMESITE-NONE | MEDIUM | Express | JavaScript | | file
d Session cookie with sameSite none.
g session(
p \bsession\(<GAP>\bcookie\s*:\s*\{[^{};]*?\bsameSite\s*:\s*(["']none["'])
c value
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Use lax or strict.

EXPRESS-SESSION-SAVEUNINITIALIZED-TRUE | MEDIUM | Express | JavaScript | | file
d Session with saveUninitialized:true.
g session(
p \bsession\(<GAP>\bsaveUninitialized\s*:\s*true\b

EXPRESS-SESSION-SECURE-FALSE | MEDIUM | Node.js | JavaScript | | file
d Session cookie with secure:false.
g session(
p \bsession\(<GAP>\bcookie\s*:\s*\{[^{};]*?\bsecure\s*:\s*false\b

FLASK-WTF-CSRF-DISABLED | HIGH | Flask | Python | | line
d Flask-WTF CSRF protection is off.
g WTF_CSRF_ENABLED
p \bWTF_CSRF_ENABLED\s*=\s*False\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Leave WTF_CSRF_ENABLED at True.

GO-INSECURE-HASH | MEDIUM | Go | Go | | line
d md5 or sha1 hash.
g md5.New sha1.New
p \b(md5|sha1)\.New\(\)
c pkg

GO-OS-EXEC-SHELL | HIGH | Go | Go | | line
d A shell is started with a command text.
g exec.Command
p \bexec\.Command\(\s*("(?:sh|bash|cmd|powershell)")\s*,\s*("(?:-c|/c)")\s*,
c shell flag

GO-TLS-INSECURE-SKIP-VERIFY | HIGH | Go | Go | | file
d TLS verification is skipped.
g tls.Config
p \btls\.Config\s*\{[^{};]*?\bInsecureSkipVerify\s*:\s*true\b

HARDCODED-BEARER-AUTH | HIGH | Node.js | JavaScript | HIGH | line
d A bearer token is written in the source.
g Bearer
p ["']?[Aa]uthorization["']?\s*:\s*(["']Bearer\s+[^"']+["'])
c header_value
o tags=secrets,sensitive-data
o cat=Secrets Exposure
o tax=data/sensitive
o cwe=CWE-798
o owasp=A07:2021
o fix=Read tokens from a secret store.

INSECURE-CRYPTO-HASH | MEDIUM | Node.js | JavaScript | HIGH | line
d md5 or sha1 through crypto.
g crypto.createHash
p \bcrypto\.createHash\(\s*(["'][^"']*(?:md5|sha1)[^"']*["'])
c alg

POTENTIAL-POLLUTION-OBJECT-ASSIGN | LOW | JavaScript | JavaScript | | line
d Object.assign() deserves a review.
g Object.assign
p \bObject\.assign\(

INSECURE-RANDOM-TOKEN | MEDIUM | JavaScript | JavaScript | | line
d A secret comes from Math.random().
g Math.random
p \b(?:var|let|const)\s+(\w*(?i:token|secret|session(?:id)?|nonce|csrf|auth|api_?key)\w*)\s*=\s*Math\.random\(\)(?:\.\w+\([^()]*\))*
c name

JAVA-INSECURE-HOSTNAME-VERIFIER | HIGH | Java | Java | | line
d Every host name is accepted.
g setHostnameVerifier
p \bsetHostnameVerifier\(\s*\(?[\w\s,]*\)?\s*->\s*true\s*\)

JAVA-INSECURE-MESSAGE-DIGEST | MEDIUM | Java | Java | | line
d MD5 or SHA-1 digest.
g MessageDigest
p \bMessageDigest\.getInstance\(\s*"(MD5|SHA-1)"
c alg

JAVA-RUNTIME-EXEC | HIGH | Java | Java | | line
d A process is started through Runtime.
g Runtime.getRuntime
p \bRuntime\.getRuntime\(\)\.exec\(

JAVA-SPRING-CSRF-DISABLE | HIGH | Spring | Java | | file
d Spring CSRF protection is disabled.
g .csrf()
p \.csrf\(\)\s*\.disable\(\)
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Keep the CSRF filter.

JWT-DECODE-ONLY | HIGH | Node.js | JavaScript | | line
d A token is decoded without verification.
g jwt.decode
p \bjwt\.decode\(

JWT-ALG-NONE | CRITICAL | Node.js | JavaScript | | line
d The none algorithm is allowed.
g algorithms
p \balgorithms\s*:\s*\[[^\]]*(["'][^"']*none[^"']*["'])
c alg

JWT-VERIFY-IGNORE-EXPIRATION | MEDIUM | Node.js | JavaScript | | file
d Expired tokens are accepted.
g jwt.verify
p \bjwt\.verify\(<GAP>\bignoreExpiration\s*:\s*true\b

NEXTJS-DANGEROUSLY-ALLOW-SVG | MEDIUM | Next.js | JavaScript | | line
d SVG images are served.
g dangerouslyAllowSVG
p \bdangerouslyAllowSVG\s*:\s*true\b
o dep=next

NEXTJS-REMOTE-PATTERN-WILDCARD | MEDIUM | Next.js | JavaScript | | line
d Any image host is allowed.
g hostname
p \bhostname\s*:\s*["']\*["']
o dep=next

NODE-TLS-REJECT-UNAUTHORIZED-ENV-ZERO | HIGH | Node.js | JavaScript | | line
d TLS validation is off by environment.
g NODE_TLS_REJECT_UNAUTHORIZED
p \bprocess\.env\.NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']0["']

NOSQL-OPERATOR-INJECTION | HIGH | Node.js | JavaScript | | line
d A query operator is used as a key.
g $where $regex $ne $gt $lt
p ["'][^"']*\$(?:where|regex|ne|gte|gt|lte|lt)[^"']*["']\s*:

OPEN-REDIRECT-LOCATION-ASSIGN | MEDIUM | JavaScript | JavaScript | MEDIUM | line
d The page location is assigned.
g .href .location
p \.(href|location)\s*=\s*([^=;\s][^;]*)
c prop *value
o literal=value
o ignore=value:^["'](#.*|/[^/].*|\./.*|\.\./.*)["']$
o taint=value

OPEN-REDIRECT-RESPONSE | MEDIUM | Node.js | JavaScript | MEDIUM | line
d A response redirects to a dynamic target.
g .redirect(
p \.redirect\(\s*(<ARG>)
c destination
o literal=destination
o taint=destination
o dep=express
o cat=Open Redirect
o tax=code-pattern/framework
o cwe=CWE-601
o owasp=A01:2021
o fix=Only redirect to allowlisted targets.

OPEN-REDIRECT-WINDOW-OPEN | MEDIUM | JavaScript | JavaScript | MEDIUM | line
d window.open() with a dynamic target.
g window.open
p \bwindow\.open\(\s*(<ARG>)
c *url
o literal=url
o taint=url

PATH-TRAVERSAL-FS-READ | HIGH | Node.js | JavaScript | MEDIUM | line
d A file is read from a dynamic path.
g fs.
p \bfs\.(?:readFileSync|readFile|createReadStream|statSync|stat)\(([^()]*(?:\([^()]*\)[^()]*)*)\)
c args
o taint=args,0

PATH-TRAVERSAL-SEND-FILE | HIGH | Node.js | JavaScript | MEDIUM | line
d A file is sent from a dynamic path.
g .sendFile(
p \.sendFile\(([^()]*(?:\([^()]*\)[^()]*)*)\)
c args
o taint=args,0

PHP-CURL-SSL-VERIFY-FALSE | HIGH | PHP | PHP | | line
d curl without certificate checks.
g CURLOPT_SSL_VERIFYPEER
p \bcurl_setopt\([^,;]*,\s*CURLOPT_SSL_VERIFYPEER\s*,\s*false\b

PHP-EVAL-EXEC | HIGH | PHP | PHP | | line
d eval() runs text as code.
g eval(
p \beval\(

PHP-INSECURE-HASH | MEDIUM | PHP | PHP | | line
d md5() or sha1().
g md5( sha1(
p \b(md5|sha1)\(
c fn

PRIVATE-KEY-MATERIAL-LITERAL | CRITICAL | JavaScript | JavaScript | HIGH | line
d Private key text in the source.
g PRIVATE
p \b(?:var|let|const)\s+[\w$]+\s*=\s*(["'][^"']*BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY[^"']*["'])
c secret_value
o tags=secrets,sensitive-data
o cat=Secrets Exposure
o tax=data/sensitive
o cwe=CWE-798
o owasp=A07:2021
o fix=Keep keys in a key vault.

PROTOTYPE-POLLUTION-SINK | MEDIUM | JavaScript | JavaScript | | line
d Nested dynamic property assignment.
g ][
p [A-Za-z_$][\w$.]*\[[^\[\]]+\]\[[^\[\]]+\]\s*=[^=]

PYTHON-EVAL-EXEC | HIGH | Python | Python | | line
d eval() runs text as code.
g eval(
p \beval\(

PYTHON-INSECURE-HASHLIB | MEDIUM | Python | Python | | line
d md5 or sha1 through hashlib.
g hashlib
p \bhashlib\.(md5|sha1)\(
c fn

PYTHON-PICKLE-LOADS | HIGH | Python | Python | | line
d Pickle data is loaded.
g pickle
p \bpickle\.(loads?)\(
c fn

PYTHON-REQUESTS-VERIFY-FALSE | HIGH | Python | Python | | file
d A request without TLS verification.
g requests.
p \brequests\.(get|post|put|patch|delete|request)\([^;]*?\bverify\s*=\s*False\b
c fn

PYTHON-SUBPROCESS-SHELL-TRUE | HIGH | Python | Python | | file
d A subprocess runs through the shell.
g subprocess.
p \bsubprocess\.(run|Popen|call|check_call|check_output)\([^;]*?\bshell\s*=\s*True\b
c fn

PYTHON-UNSAFE-YAML-LOAD | HIGH | Python | Python | | line
d yaml.load() may build objects.
g yaml.load
p \byaml\.load\(

RAILS-PROTECT-FROM-FORGERY-NULL-SESSION | MEDIUM | Rails | Ruby | | line
d CSRF failures only drop the session.
g protect_from_forgery
p \bprotect_from_forgery\b[^\n#]*\bwith:\s*:null_session\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Use with: :exception.

RAILS-SKIP-VERIFY-AUTHENTICITY-TOKEN | HIGH | Rails | Ruby | | line
d The authenticity check is skipped.
g verify_authenticity_token
p \bskip_(?:before_action|before_filter|forgery_protection)\b[\s(]*:verify_authenticity_token\b
o tags=csrf
o rcwe=CWE-352
o rowasp=A01:2021
o rfix=Keep the check on state-changing actions.

REACT2SHELL-01 | CRITICAL | React | JavaScript | | line
d A use server directive exposes functions.
g use server
p ^\s*(["']use server["'])
c directive

REACT-UNSAFE-URL-PROP | MEDIUM | React | JavaScript | | line
d A script URL in a JSX property.
g javascript: data:text/html
p \b[A-Za-z][\w-]*=\{?\s*(["'`]\s*(?i:javascript:|data:text/html)[^"'`]*["'`])
c url
o dep=react
o cat=Cross-Site Scripting
o tax=code-pattern/framework
o cwe=CWE-79
o owasp=A03:2021
o fix=Allow safe URL schemes only.

RUBY-DIGEST-MD5 | MEDIUM | Ruby | Ruby | | line
d MD5 digest.
g Digest::MD5
p \bDigest::MD5\.hexdigest\b

RUBY-OPENSSL-VERIFY-NONE | HIGH | Ruby | Ruby | | line
d TLS verification is off.
g VERIFY_NONE
p \bOpenSSL::SSL::VERIFY_NONE\b

RUBY-SYSTEM-CALL | HIGH | Ruby | Ruby | | line
d system() runs a shell command.
g system
p \bsystem[\s(]\s*["'\w]

RUBY-YAML-LOAD | HIGH | Ruby | Ruby | | line
d YAML.load() may build objects.
g YAML.load
p \bYAML\.load\b

RUST-COMMAND-SHELL | HIGH | Rust | Rust | | file
d A shell is started with a command text.
g Command::new
p \bCommand::new\("(sh|bash|cmd|powershell)"\)\s*\.arg\("(-c|/c)"\)\s*\.arg\([^()]*\)\s*\.(status|output|spawn)\(\)
c shell flag exec

RUST-MD5-COMPUTE | MEDIUM | Rust | Rust | | line
d MD5 digest.
g md5::compute
p \bmd5::compute\(

RUST-REQWEST-INVALID-CERTS | HIGH | Rust | Rust | | file
d Invalid certificates are accepted.
g danger_accept_invalid_certs
p \breqwest::Client::builder\(\)\s*\.danger_accept_invalid_certs\(true\)\s*\.build\(\)

SHELL-WRAPPER-EXEC | CRITICAL | Node.js | JavaScript | | line
d A shell wrapper runs a command.
g execa( $( shelljs.exec
p \bexeca\(|(?:^|[^\w$.])\$\(|\bshelljs\.exec\(

SQL-RAW-QUERY | HIGH | Node.js | JavaScript | HIGH | line
d A raw query is executed.
g .query( .execute( .raw(
p \b(\w+)\.(query|execute|raw)\(\s*(<ARG>)
c receiver method *sql
o require=receiver:(?i)^(db|database|conn|connection|client|pool|sequelize|knex|prisma|mongoose|mysql|pg|sqlite|trx)$
o taint=sql

SQL-TEMPLATE-LITERAL-QUERY | HIGH | Node.js | JavaScript | | line
d A template literal is used as a query.
g .query( .execute( .raw(
p [A-Za-z_$][\w$.]*\.(?:query|execute|raw)\(\s*(`[^`]*`)
c sql_template

SSRF-AXIOS | HIGH | JavaScript | JavaScript | HIGH | line
d axios request to a dynamic target.
g axios.
p \baxios\.(?:get|post|put|patch|delete|request)\(\s*(<ARG>)
c *url
o taint=url

SSRF-FETCH | HIGH | JavaScript | JavaScript | HIGH | line
d fetch() of a dynamic target.
g fetch(
p (?:^|[^\w$.])fetch\(\s*(<ARG>)
c *url
o taint=url

SSRF-HTTP-REQUEST | HIGH | Node.js | JavaScript | HIGH | line
d http request to a dynamic target.
g http. https.
p \bhttps?\.(?:request|get)\(\s*(<ARG>)
c *url
o taint=url

JS-STRING-TIMER-EXEC | MEDIUM | JavaScript | JavaScript | | line
d A timer runs text as code.
g setTimeout setInterval
p \b(?:setTimeout|setInterval)\(\s*("[^"]*"|'[^']*')
c string_code

TEMPLATE-INJECTION-COMPILE | HIGH | Node.js | JavaScript | | line
d A template is compiled at run time.
g Handlebars. ejs. pug.
p \b(?:Handlebars|ejs|pug)\.(?:compile|render)\(

TLS-REJECT-UNAUTHORIZED-FALSE | HIGH | Node.js | JavaScript | | line
d TLS validation is off.
g rejectUnauthorized
p \brejectUnauthorized\s*:\s*false\b

UNSAFE-DESERIALIZATION-CALL | HIGH | Node.js | JavaScript | | line
d Data is deserialised by an unsafe library.
g serialize
p \b(?:serialize|phpserialize|v8|bson|ejson)\.(?:deserialize|unserialize)\(

POTENTIAL-POLLUTION-OBJECT-SPREAD | LOW | React | JavaScript | | line
d Untrusted data is spread into an object.
g ...
p \{[^{}]*\.\.\.\s*((?i:payload|input|user(?:input|data)?|body|query|params|request(?:body)?|data)|(?:req|request|ctx)\.(?:body|query|params))\s*[,}]
c source

UNSAFE-VM-EXECUTION | CRITICAL | Node.js | JavaScript | | line
d vm executes code.
g vm.
p \bvm\.(?:runInNewContext|runInContext|runInThisContext|compileFunction)\(|\bnew\s+vm\.Script\b

UNSAFE-YAML-LOAD | HIGH | Node.js | JavaScript | | line
d yaml.load() on untrusted text.
g yaml.load
p \b(?:yaml|jsyaml)\.load\(

VUE-RENDER-INNERHTML | HIGH | Vue | JavaScript | | file
d A render function sets innerHTML.
g innerHTML
p (?:^|[^\w$.])h\(<GAP>\binnerHTML\s*:
o dep=vue,nuxt
o cat=Cross-Site Scripting
o tax=code-pattern/framework
o cwe=CWE-79
o owasp=A03:2021
o fix=Use escaped bindings.

XSS-01 | HIGH | React | JavaScript | HIGH | line
d dangerouslySetInnerHTML with dynamic text.
g dangerouslySetInnerHTML
p \bdangerouslySetInnerHTML=\{\{\s*__html\s*:\s*([^\s{}][^{}]*)
c *html_value
o taint=html_value
o dep=react
o cat=Cross-Site Scripting
o tax=code-pattern/framework
o cwe=CWE-79
o owasp=A03:2021
o fix=Sanitise the HTML first.

YAML-INSECURE-SKIP-TLS-VERIFY | HIGH | YAML | YAML | | line
d TLS verification is skipped.
g insecureSkipTlsVerify
p ^\s*-?\s*insecureSkipTlsVerify:\s*true\s*$

YAML-PRIVILEGED-CONTAINER | HIGH | YAML | YAML | | line
d A container runs privileged.
g privileged
p ^\s*-?\s*privileged:\s*true\s*$

YAML-VERIFY-FALSE | HIGH | YAML | YAML | | line
d Verification is off.
g verify
p ^\s*-?\s*verify:\s*false\s*$
"""
