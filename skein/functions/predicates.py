"""Boolean and classifying expressions over call, intent and API names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inter-component calls that send, and those that receive.
SENDING_APIS = [
    "startActivity", "startActivities", "startActivityForResult", "startActivityFromChild", "startActivityFromFragment", "startActivityIfNeeded",
    "startNextMatchingActivity", "sendBroadcast", "sendBroadcastAsUser", "sendOrderedBroadcast", "sendOrderedBroadcastAsUser",
    "sendStickyBroadcast", "sendStickyBroadcastAsUser", "sendStickyOrderedBroadcast", "sendStickyOrderedBroadcastAsUser",
    "removeStickyBroadcast", "removeStickyBroadcastAsUser", "bindService", "startService", "stopService", "startIntentSender",
    "startIntentSenderForResult", "startIntentSenderFromChild",
]
RECEIVING_APIS = ["getIntent", "getParentActivityIntent"]
# Lifecycle classes in order of precedence, and class names of the platform (a whole name must match).
LIFECYCLE_ORDER = ["Activity", "Application", "BroadcastReceiver", "ContentProvider", "Service"]
ANDROID_PATTERN = r"(android|com\.example\.android|com\.google|com\.android|dalvik)\.(.)+"
OTHER_SDK_PATTERN = r"(gov\.nist|java|javax|junit|libcore|net\.oauth|org\.apache|org\.ccil|org\.javia|org\.jivesoftware|org\.json|org\.w3c|org\.xml|sun|com\.adobe|com\.svox|jp\.co\.omronsoft|org\.kxml2|org\.xmlpull)\.(.)+"
SDK_PATTERN = f"^(?:{ANDROID_PATTERN}|{OTHER_SDK_PATTERN})$"
# Method names of platform classes, parts of invoked names, and parts of any instruction that malware favours.
SUSPICIOUS_NAMES = ["getExternalStorageDirectory", "getSimCountryIso", "execHttpRequest", "sendTextMessage", "getSubscriberId", "getDeviceId", "getPackageInfo", "getSystemService", "getWifiState", "setWifiEnabled", "setWifiDisabled", "Cipher"]
SUSPICIOUS_PARTS = ["Ljava/net/HttpURLconnection;->setRequestMethod(Ljava/lang/String;)", "Ljava/net/HttpURLconnection", "Lorg/apache/http/client/methods/HttpPost", "Landroid/telephony/SmsMessage;->getMessageBody", "Ljava/io/IOException;->printStackTrace", "Ljava/lang/Runtime;->exec"]
SUSPICIOUS_TEXTS = ["system/bin/su", "android/os/Exec"]


def is_set(c: Column) -> Column:
    """A record field holds the text ``null`` when it has no value."""
    return c.isNotNull() & (c != "null")


def is_explicit(component: Column) -> Column:
    return is_set(component)


def has_extras(extras: Column) -> Column:
    return is_set(extras)


def has_data(data: Column) -> Column:
    return is_set(data)


def code_layer(cls: Column, package: Column, sdk: str = SDK_PATTERN) -> Column:
    """``UserCode`` when the class name contains the app's package, ``SDK`` by pattern, else ``3rdLib``; null is ``Unknown``."""
    return F.when(cls.isNull() | (cls == ""), "Unknown").when(F.contains(cls, package), "UserCode").when(cls.rlike(sdk), "SDK").otherwise("3rdLib")


def is_sending_api(name: Column) -> Column:
    return name.isin(*SENDING_APIS)


def is_receiving_api(name: Column) -> Column:
    return name.isin(*RECEIVING_APIS)


def mentions_any(text: Column, names: Sequence[str]) -> Column:
    """Whether the text contains one of the names anywhere (a statement, not a bare name)."""
    out = F.lit(False)
    for n in names:
        out = out | F.contains(text, F.lit(n))
    return out


def in_list_either_way(s: Column, names: Column) -> Column:
    """Whether a name of the array contains ``s`` or is contained in it."""
    return F.exists(names, lambda t: F.contains(s, t) | F.contains(t, s))


def lifecycle_type(method: Column, methods: Mapping[str, Sequence[str]]) -> Column:
    """First type, in the fixed order of precedence, whose methods hold the name; null for others."""
    return F.coalesce(*[F.when(method.isin(*methods.get(t, [])), F.lit(t)) for t in LIFECYCLE_ORDER])


def _invoked(instructions: Column) -> Column:
    """Trimmed operands that name a method, of the instructions that invoke one."""
    operands = F.flatten(F.transform(F.filter(instructions, lambda i: F.contains(i, F.lit("invoke-"))), lambda i: F.split(i, ",")))
    return F.transform(F.filter(operands, lambda o: F.contains(o, F.lit(";->"))), lambda o: F.trim(o))


def platform_apis(instructions: Column) -> Column:
    """Array of (class, name): the platform methods that instructions invoke, in order."""
    own = F.filter(_invoked(instructions), lambda o: o.startswith("Landroid"))
    name = lambda o: F.trim(F.split_part(F.split_part(o, F.lit(";->"), F.lit(2)), F.lit("("), F.lit(1)))
    return F.transform(own, lambda o: F.struct(F.trim(F.split_part(o, F.lit(";->"), F.lit(1))).alias("class"), name(o).alias("name")))


def suspicious_apis(instructions: Column) -> Column:
    """Distinct suspicious calls of an array of instruction texts, sorted.

    ``class.name`` of an invoked platform method whose name is a listed one; a listed part that an invoked name
    contains; a listed text that any instruction contains. A null array gives null.
    """
    named = F.transform(F.filter(platform_apis(instructions), lambda a: a["name"].isin(*SUSPICIOUS_NAMES)), lambda a: F.concat(a["class"], F.lit("."), a["name"]))
    holds = lambda marks, texts: F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.exists(texts, lambda t: F.contains(t, m)))
    return F.array_sort(F.array_distinct(F.concat(named, holds(SUSPICIOUS_PARTS, _invoked(instructions)), holds(SUSPICIOUS_TEXTS, instructions))))


def used_and_restricted(requested: Column, needed: Column) -> Column:
    """Struct (used, restricted): needed permissions that were requested, and the others, sorted and distinct."""
    return F.struct(F.array_sort(F.array_intersect(needed, requested)).alias("used"), F.array_sort(F.array_except(needed, requested)).alias("restricted"))


def is_method_field(field_type: Column, cls: Column) -> Column:
    """Fields that hold a reflective method, outside support classes."""
    return (field_type == "java.lang.reflect.Method") & ~cls.startswith("android.support.")
