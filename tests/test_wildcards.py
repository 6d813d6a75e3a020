"""Wildcards of XML Schema: namespaces they take, and how what they take is checked."""

import pytest

from billprism.plans.schema import Checker, Schema
from billprism.sources.shred import parse


def kinds(wild, child):
    main = f'''<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:a" xmlns="urn:a" elementFormDefault="qualified">
    <xs:import namespace="urn:b" schemaLocation="b.xsd"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="id" type="xs:string"/><xs:any {wild} minOccurs="0" maxOccurs="2"/></xs:sequence></xs:complexType></xs:element>
    <xs:element name="own" type="xs:integer"/></xs:schema>'''
    other = '''<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:b"><xs:element name="known" type="xs:integer"/></xs:schema>'''
    schema = Schema.from_texts({"a.xsd": main, "b.xsd": other}, "a.xsd")
    return [k for k, _, _ in Checker(schema).run(parse(f'<r xmlns="urn:a" xmlns:b="urn:b"><id>1</id>{child}</r>'))]


@pytest.mark.parametrize(
    ("wild", "child", "want"),
    [
        ('namespace="##other"', "<b:known>1</b:known>", []),
        ('namespace="##other"', "<own>1</own>", ["unexpected-element"]),
        ('namespace="##other"', "<b:known>x</b:known>", ["value"]),
        ('namespace="##other"', "<b:strange/>", ["unexpected-element"]),
        ('namespace="##other" processContents="lax"', "<b:strange/>", []),
        ('namespace="##other" processContents="skip"', "<b:known>x</b:known>", []),
        ('namespace="##targetNamespace"', "<own>1</own>", []),
        ('namespace="##targetNamespace"', "<b:known>1</b:known>", ["unexpected-element"]),
        ('namespace="##local" processContents="lax"', '<x xmlns=""/>', []),
        ('namespace="urn:b urn:c"', "<b:known>1</b:known>", []),
        ("", "<own>1</own><b:known>2</b:known>", []),
    ],
)
def test_wildcards(wild, child, want):
    assert kinds(wild, child) == want


def test_too_many_for_a_wildcard():
    assert kinds("", "<own>1</own><own>2</own><own>3</own>") != []
