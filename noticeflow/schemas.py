"""The relations: one schema each, declared once."""

from __future__ import annotations

#: Discovery ledger.
SEEN = "tender_id string, title string, source_site string, url string, date_first_seen timestamp"

#: What normalisation makes of a raw row, with the longest text a column keeps (NRM-13).
NORMALISED = "tender_id string, title string, title_clean string, content_hash string, description string, organization string, country string, source_site string, url string, published date, deadline date, value string, word_count int, has_description boolean, is_expired boolean"
WIDTHS = {"tender_id": 255, "title": 500, "title_clean": 500, "description": 10_000, "organization": 300, "country": 100, "source_site": 100, "url": 1000, "value": 200}

STRUCTURED = "tender_id string, sector string, consulting_type string, region string, organization string, deadline_category string, relevance_score int, priority_score int, bid_fit_score int, competition_level string, opportunity_size string, complexity_score int, insight string, confidence int, decision_tag string"
LIFECYCLE = "tender_id string, status string, owner string, bid_decision string, outcome string, model_decision_tag string, proposal_deadline date, evaluated_at timestamp, updated_at timestamp"
FINGERPRINT = "content_hash string, source_portal string, tender_id string, first_seen timestamp"
CROSS_SOURCE = "tender_id string, portal string, url string, title string, first_seen timestamp"
EARLY_PROJECT = "project_id string, name string, status string, description string, score int, last_score int, content_hash string, last_seen timestamp, notified boolean"
SIGNAL = "signal_uid string, url_hash string, title_hash string, content_hash string, source string, title string, description string, confidence int, stage string, captured_at timestamp"
ANSWER_EVENT = "event_id long, ts timestamp, query string, query_type string, answer string, abstained boolean, n_sources int, citations array<int>, latency_ms double"
ANSWER_FEEDBACK = "event_id long, rating int, labels array<string>"
RUN = "source string, run_at timestamp, status string, row_count long, attempts int"
VECTOR = "vec_id long, embedding array<float>, label int"
LINKS = "array<struct<url:string,label:string,file_type:string,extracted:boolean,char_count:int>>"
