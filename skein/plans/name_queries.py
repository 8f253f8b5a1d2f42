"""Names of calls, classes and addresses, against SQL that spells every list and pattern out."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import predicates as P
from skein.functions import text as X
from skein.operators import counts

from ._tables import read

CLASSES = [
    "android.app.Activity", "com.example.android.x.Main", "com.google.ads.A", "com.android.x.B", "dalvik.system.C", "gov.nist.D", "java.util.E", "javax.F", "junit.G", "libcore.io.H", "net.oauth.I", "org.apache.J",
    "org.ccil.K", "org.javia.L", "org.jivesoftware.M", "org.json.N", "org.w3c.O", "org.xml.P", "sun.Q", "com.adobe.R", "com.svox.S", "jp.co.omronsoft.T", "org.kxml2.U", "org.xmlpull.V",
    "com.app.one.Main", "org.example.X", "android", "xandroid.app.Y", "androidx.core.Z", "com.example.android", "java.com.app.one.W", "",
]
CALLS = [
    "startActivity", "startActivities", "startActivityForResult", "startActivityFromChild", "startActivityFromFragment", "startActivityIfNeeded", "startNextMatchingActivity", "sendBroadcast", "sendBroadcastAsUser",
    "sendOrderedBroadcast", "sendOrderedBroadcastAsUser", "sendStickyBroadcast", "sendStickyBroadcastAsUser", "sendStickyOrderedBroadcast", "sendStickyOrderedBroadcastAsUser", "removeStickyBroadcast",
    "removeStickyBroadcastAsUser", "bindService", "startService", "stopService", "startIntentSender", "startIntentSenderForResult", "startIntentSenderFromChild", "getIntent", "getParentActivityIntent",
    "setResult", "onNewIntent", "onReceive", "onBind", "unbindService", "startactivity", "getIntents",
]
INSTRUCTIONS = [
    "invoke-virtual v0, v1, Landroid/telephony/SmsManager;->sendTextMessage(Ljava/lang/String;)V", "invoke-static Landroid/os/Environment;->getExternalStorageDirectory()Ljava/io/File;", "const-string v1, Cipher",
    "invoke-virtual v2, Ljava/net/HttpURLconnection;->setRequestMethod(Ljava/lang/String;)V", "invoke-direct v0, Lorg/apache/http/client/methods/HttpPost;-><init>(Ljava/lang/String;)V",
    "invoke-static v3, Landroid/telephony/SmsMessage;->getMessageBody()Ljava/lang/String;", "invoke-virtual v1, Ljava/io/IOException;->printStackTrace()V", "invoke-virtual v0, Ljava/lang/Runtime;->exec(Ljava/lang/String;)V",
    "const-string v2, /system/bin/su", "invoke-static Landroid/os/Exec;->createSubprocess()V", "invoke-virtual v0, Landroid/content/Context;->getPackageName()V", "invoke-virtual v0, Ljavax/crypto/Cipher;->doFinal()V",
    "sget v0, Landroid/telephony/SmsManager;->sendTextMessage", "invoke-virtual v4, Ldalvik/system/DexClassLoader;->loadClass()V", "invoke-virtual  v0 ,  Landroid/net/wifi/WifiManager ;-> getWifiState (I)V", "return-void",
]
LINKS = [
    "http://10.1.2.3/x", "https://site.technology/a", "HTTP://A.b.com:80/", "see https://a.example.com/q x", "none", "http://localhost/x", "http://1.2.3.4:8080/x", "https://a.io\\share", "ftp://a.com/x", "http://ex.co.uk", "http://x.y{2, 6}/z",
    "http://a.b.c.d.info'x", "https://-.com", "", "http://",
]
ADDRESSES = [
    "192.168.0.1", "a 192.168.0.1 b", "hey everybody", "www.google.com", "google.com", "true", "http://www.google.com/a/b/v.htm", "example.technology", "010.001.0.1", "10.0.0.1.", "market://details?id=x.y", "content://sms/inbox",
    "see http://a.com/b now", "256.1.1.1", "a.b-.com", "-a.com", "x.y", "mailto:a@b.example", "HTTP://A.COM", "http://a.com/%7euser#top", "http://a.com/%7", "urn:", "a:b c", "http://[::1]/x", "http://[1:2:3:4:5:6:7:8]:80/", "x1.2.3.4", "1.2.3.4.5",
    "a" * 64 + ".com", "http://u:p@h.org:8080/a//b?q=/?#f/?", "é.com", "http://é.com/ü",
]


def _chosen(key: str, values: list[str], step: int = 1):
    """One of ``values`` by a key."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) * step % len(values)).cast("int"))


def _sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def code_layers(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", P.code_layer(_chosen("p_partkey", CLASSES), F.lit("com.app.one")).alias("layer"))


def message_apis(spark, sf_dir):
    name = _chosen("p_partkey", CALLS)
    statement = F.concat(F.lit("virtualinvoke r0.<android.content.Context: void "), name, F.lit("(android.content.Intent)>(r1)"))
    return read(spark, sf_dir, "part").select("p_partkey", P.is_sending_api(name).alias("sends"), P.is_receiving_api(name).alias("receives"), P.mentions_any(statement, P.SENDING_APIS).alias("statement_sends"), P.mentions_any(statement, P.RECEIVING_APIS).alias("statement_receives"))


def suspicious_calls(spark, sf_dir):
    found = P.suspicious_apis(F.array(*[_chosen("p_partkey", INSTRUCTIONS, s) for s in (1, 3, 7)]))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("call"))


def lifecycle_types(spark, sf_dir):
    methods = {"Activity": ["onCreate", "onPause"], "Service": ["onCreate", "onBind"], "ContentProvider": ["query"], "Application": ["onTerminate"]}
    return read(spark, sf_dir, "part").select("p_partkey", P.lifecycle_type(_chosen("p_partkey", ["onCreate", "onBind", "query", "onTerminate", "other"]), methods).alias("type"), P.is_method_field(_chosen("p_partkey", ["java.lang.reflect.Method", "int", "java.lang.reflect.Method"]), _chosen("p_partkey", ["android.support.A", "b.C"])).alias("reflective"))


def url_domains(spark, sf_dir):
    link = _chosen("p_partkey", LINKS)
    own = read(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_partkey").alias("id"), X.url_domain(link).alias("domain"), X.url_domain(link, literal=True).alias("literal"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("id"), X.url_domain(F.col("url")).alias("domain"), X.url_domain(F.col("url"), literal=True).alias("literal"))
    return own.unionAll(pages)


def net_addresses(spark, sf_dir):
    """Address kinds and counts of the pages' addresses, as they are and as bare hosts, and of awkward texts."""
    pages = read(spark, sf_dir, "pages")
    texts = pages.select(F.col("url").alias("v")).unionAll(pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1))).unionAll(read(spark, sf_dir, "part").select(_chosen("p_partkey", ADDRESSES)))
    found = texts.select(X.net_address(F.col("v")).alias("a")).where("a IS NOT NULL").select("a.kind", "a.address")
    return counts.count_by(found, ["kind", "address"])


def document_addresses(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", X.net_address(F.col("text")).alias("a")).where("a IS NOT NULL")
    return found.select("doc_id", "a.kind", "a.address")


_PARTS = "WITH p AS (SELECT p_partkey, {v}[p_partkey * {s} % {n} + 1] AS v FROM part) "


def _parts(values: list[str]) -> str:
    return _PARTS.format(v=_sql(values), n=len(values), s=1)


_SENDS = "['startActivity', 'startActivities', 'startActivityForResult', 'startActivityFromChild', 'startActivityFromFragment', 'startActivityIfNeeded', 'startNextMatchingActivity', 'sendBroadcast', 'sendBroadcastAsUser', 'sendOrderedBroadcast', 'sendOrderedBroadcastAsUser', 'sendStickyBroadcast', 'sendStickyBroadcastAsUser', 'sendStickyOrderedBroadcast', 'sendStickyOrderedBroadcastAsUser', 'removeStickyBroadcast', 'removeStickyBroadcastAsUser', 'bindService', 'startService', 'stopService', 'startIntentSender', 'startIntentSenderForResult', 'startIntentSenderFromChild']"
_IP = r"\b((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))\b"
_HOST = r"([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}"
# without look-around, and with the numeric literals of the texts only
_PCHAR = r"(%[0-9a-f]{2}|[-a-z0-9._~\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{1FFFD}!$&''()*+,;=:@])"
_IRI = rf"[a-z][-a-z0-9+.]*:(//({_PCHAR}*@)?(\[[0-9a-f:.]+\]|{_PCHAR}*)(:[0-9]*)?(/{_PCHAR}*)*|/({_PCHAR}+(/{_PCHAR}*)*)?|{_PCHAR}+(/{_PCHAR}*)*|)(\?({_PCHAR}|[/?])*)?(#({_PCHAR}|[/?])*)?"


def _address(c: str) -> str:
    kind = f"CASE WHEN regexp_matches({c}, '{_IP}') THEN 'ip' WHEN regexp_full_match({c}, '{_HOST}') AND length({c}) BETWEEN 4 AND 253 THEN 'host' WHEN regexp_full_match({c}, '{_IRI}') THEN 'iri' END"
    return f"{kind} AS kind, CASE WHEN regexp_matches({c}, '{_IP}') THEN regexp_extract({c}, '{_IP}', 1) ELSE {c} END AS address"


def _domain(c: str, literal: bool) -> str:
    host = r"([\da-z.-]+\.[a-z.]\{2, 6\}|[\d.]+)" if literal else r"([\da-z.-]+\.[a-z.]{2,6}|[\d.]+)"
    return f"nullif(regexp_extract(regexp_extract({c}, '(?i)https?://{host}[^''\"]*', 0), '(?i)https?://([^/:\\\\]*)', 1), '')"


QUERIES = {f.__name__: f for f in (code_layers, message_apis, suspicious_calls, lifecycle_types, url_domains, net_addresses, document_addresses)}
ORACLES = {
    "code_layers": _parts(CLASSES)
    + r"""SELECT p_partkey, CASE WHEN v = '' THEN 'Unknown' WHEN contains(v, 'com.app.one') THEN 'UserCode'
WHEN regexp_full_match(v, '(android|com\.example\.android|com\.google|com\.android|dalvik)\.(.)+') THEN 'SDK'
WHEN regexp_full_match(v, '(gov\.nist|java|javax|junit|libcore|net\.oauth|org\.apache|org\.ccil|org\.javia|org\.jivesoftware|org\.json|org\.w3c|org\.xml|sun|com\.adobe|com\.svox|jp\.co\.omronsoft|org\.kxml2|org\.xmlpull)\.(.)+') THEN 'SDK' ELSE '3rdLib' END AS layer FROM p""",
    "message_apis": _parts(CALLS)
    + f"""SELECT p_partkey, list_contains({_SENDS}, v) AS sends, list_contains(['getIntent', 'getParentActivityIntent'], v) AS receives,
len(list_filter({_SENDS}, lambda x: contains(v, x))) > 0 AS statement_sends, contains(v, 'getIntent') OR contains(v, 'getParentActivityIntent') AS statement_receives FROM p""",
    "suspicious_calls": f"""WITH i AS (SELECT p_partkey, {_sql(INSTRUCTIONS)}[p_partkey * s % {len(INSTRUCTIONS)} + 1] AS i FROM part, (VALUES (1), (3), (7)) t(s)),
o AS (SELECT p_partkey, trim(o) AS o FROM (SELECT p_partkey, unnest(string_split(i, ',')) AS o FROM i WHERE contains(i, 'invoke-')) WHERE contains(o, ';->')),
a AS (SELECT p_partkey, trim(string_split(o, ';->')[1]) AS c, trim(string_split(string_split(o, ';->')[2], '(')[1]) AS m FROM o WHERE starts_with(o, 'Landroid'))
SELECT p_partkey, c || '.' || m AS call FROM a WHERE m IN ('getExternalStorageDirectory', 'getSimCountryIso', 'execHttpRequest', 'sendTextMessage', 'getSubscriberId', 'getDeviceId', 'getPackageInfo', 'getSystemService', 'getWifiState', 'setWifiEnabled', 'setWifiDisabled', 'Cipher')
UNION SELECT p_partkey, x FROM o, (VALUES ('Ljava/net/HttpURLconnection;->setRequestMethod(Ljava/lang/String;)'), ('Ljava/net/HttpURLconnection'), ('Lorg/apache/http/client/methods/HttpPost'), ('Landroid/telephony/SmsMessage;->getMessageBody'), ('Ljava/io/IOException;->printStackTrace'), ('Ljava/lang/Runtime;->exec')) t(x) WHERE contains(o, x)
UNION SELECT p_partkey, x FROM i, (VALUES ('system/bin/su'), ('android/os/Exec')) t(x) WHERE contains(i, x)""",
    "lifecycle_types": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Activity' WHEN 1 THEN 'Service' WHEN 2 THEN 'ContentProvider' WHEN 3 THEN 'Application' END AS type, p_partkey % 3 <> 1 AND p_partkey % 2 = 1 AS reflective FROM part""",
    "url_domains": _parts(LINKS) + f"SELECT 'part ' || p_partkey AS id, {_domain('v', False)} AS domain, {_domain('v', True)} AS literal FROM p UNION ALL SELECT 'page ' || page_id, {_domain('url', False)}, {_domain('url', True)} FROM pages",
    "net_addresses": _parts(ADDRESSES) + f"SELECT kind, address, count(*) AS cnt FROM (SELECT {_address('v')} FROM (SELECT v FROM p UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) FROM pages)) WHERE kind IS NOT NULL GROUP BY ALL",
    "document_addresses": f"SELECT * FROM (SELECT doc_id, {_address('text')} FROM documents) WHERE kind IS NOT NULL",
}
