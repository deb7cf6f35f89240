"""Types that XML resources name: by the place in the document, in text and attributes."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import QUALIFIED

# Elements of deployment descriptors whose whole text is a class name.
CLASS_ELEMENTS = {
    "web-app/filter/filter-class",
    "web-app/listener/listener-class",
    "web-app/servlet/servlet-class",
    "ejb-jar/assembly-descriptor/application-exception/exception-class",
    "ejb-jar/assembly-descriptor/interceptor-binding/interceptor-class",
    "ejb-jar/enterprise-beans/entity/home",
    "ejb-jar/enterprise-beans/entity/remote",
    "ejb-jar/enterprise-beans/entity/ejb-class",
    "ejb-jar/enterprise-beans/entity/prim-key-class",
    "ejb-jar/enterprise-beans/message-driven/ejb-class",
    "ejb-jar/enterprise-beans/message-driven/messaging-type",
    "ejb-jar/enterprise-beans/message-driven/resource-ref/injection-target/injection-target-class",
    "ejb-jar/enterprise-beans/message-driven/resource-env-ref/injection-target/injection-target-class",
    "ejb-jar/enterprise-beans/session/home",
    "ejb-jar/enterprise-beans/session/local",
    "ejb-jar/enterprise-beans/session/remote",
    "ejb-jar/enterprise-beans/session/business-local",
    "ejb-jar/enterprise-beans/session/business-remote",
    "ejb-jar/enterprise-beans/session/service-endpoint",
    "ejb-jar/enterprise-beans/session/ejb-class",
    "ejb-jar/enterprise-beans/session/ejb-ref/home",
    "ejb-jar/enterprise-beans/session/ejb-ref/remote",
    "ejb-jar/interceptors/interceptor/around-invoke/class",
    "ejb-jar/interceptors/interceptor/ejb-ref/home",
    "ejb-jar/interceptors/interceptor/ejb-ref/remote",
    "ejb-jar/interceptors/interceptor/interceptor-class",
}
_QUALIFIED = re.compile(QUALIFIED, re.ASCII)


def mentions(text: str | None) -> list[tuple[str, str, str]]:
    """(member, target, kind) of the types that an XML text names, each once for its place, in order; a text that isn't XML is searched as it stands."""
    found, path = {}, []

    def named(member: str, value: str) -> None:
        for m in _QUALIFIED.finditer(value):
            found[member, m[0], "resource-xml"] = None

    def start(name: str, attributes: dict[str, str]) -> None:
        path.append(name.rsplit(":", 1)[-1])
        for key, value in attributes.items():
            named(f"{'/'.join(path)}/@{key.rsplit(':', 1)[-1]}", value)

    def characters(value: str) -> None:
        here = "/".join(path)
        if here not in CLASS_ELEMENTS:
            named(here, value)
        elif value.strip():
            found[here, value.strip(), "resource-xml-path"] = None

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler = start, characters
    parser.EndElementHandler = lambda _: path.pop()
    try:
        parser.Parse(text or "", True)
    except expat.ExpatError:
        found.clear()
        named("xml", text or "")
    return list(found)


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("member", "target", "kind")])))
def xml_mentions(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("member", "target", "kind"), m)) for m in mentions(t)])
