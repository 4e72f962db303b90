"""Table schemas. Values are canonical JSON text: object keys sorted, whole numbers without a fraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

KEY_DEFS = (
    "key string, shape string, target string, limits struct<max:int,severity:string>, budget struct<desktop:int,mobile:int>, "
    "`values` array<string>, vars array<string>, requires array<string>, tags int, derives_from string, tmpl string, pages array<string>, label string"
)
PAGE_DEFS = (
    "page string, route string, parent string, locales array<string>, seo struct<title:string,description:string,robots:string,canonical:string,og_image:string,og_image_alt:string>, "
    "json_ld struct<type:string,bindings:map<string,string>>"
)
TEMPLATE_DEFS = "template string, class string, trigger string, slots array<string>, wrapper_provides array<string>"
SNAPSHOT = "locale string, key string, value_json string"
VERSIONS = (
    "id long, project string, key string, locale string, target string, value_json string, state string, is_active boolean, publish_at timestamp, label string, note string, "
    "editor string, published_by string, reverted_from long, created_at timestamp, published_at timestamp, changeset_id long"
)
CHANGESETS = "id long, project string, name string, note string, status string, author_kind string, publish_at timestamp, created_at timestamp, reverted_at timestamp"
GROUPS = "project string, key string, name string, state string, properties array<struct<name:string,type:string,values:array<string>,required:boolean>>, created_at timestamp, updated_at timestamp"
CONTACTS = "id long, project string, email string, properties map<string,string>, created_at timestamp, updated_at timestamp"
MEMBERSHIPS = "id long, contact_id long, project string, group_key string, joined_at timestamp, form string, page string, properties map<string,string>, updated_at timestamp"
SUPPRESSIONS = "email string, scope string, source string, created_at timestamp"
ERASURES = "project string, email_hash string, erased_at timestamp"
FINDINGS = "rule string, severity string, seq int, key string, page string, locale string, message string, detail map<string,string>"


@dataclass
class Descriptor:
    """What a project declares: keys, pages and templates as tables."""

    keys: DataFrame
    pages: DataFrame
    templates: DataFrame
