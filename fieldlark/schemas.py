"""Schemas of the domain tables, as DDL strings."""

STUDY = "id_key long, name string"
SAMPLE = "id_key long, observation double, point_id long, study_id long, year int"
POINT = "id_key long, latitude double, longitude double"
GEOLOCATION_NAME = "id_key long, geolocation_name string, geolocation_type string"
GEOLOCATION_TO_POINT = "point_id long, geolocation_id long"
COVARIATE_DEFN = (
    "id_key int, name string, editable_name boolean, display_order double, description string, queryable boolean, "
    "always_display boolean, hidden boolean, show_in_point_table boolean, search_by_unique boolean, covariate_type int, covariate_association int"
)
COVARIATE_VALUE = "id_key long, value string, covariate_defn_id int, study_id long, sample_id long"
CONTENT = "id long, content_hash string, text string, is_valid int"
LINKS = "id long, url string, content_id long, fetch_error string"
SPECIES = "id long, name string"
QUESTIONS = "id long, text string, keyword_phrase string"
SPECIES_QUESTIONS = "species_id long, question_id long"
QUESTION_LINKS = "id long, question_id long, link_id long"
ANSWERS = "id long, question_link_id long, question_id long, link_id long, answer_text string, reason string, evidence array<string>, context string"
RASTER_PIXEL = "dataset_id string, band string, ts timestamp, pixel_id long, lat double, lon double, value double, label int"
POINT_TABLE = "Latitude double, Longitude double, Year int"
SEARCH_RESULT = "title string, link string, snippet string"
LINK_RESULT = "question_id long, url string"

#: Covariate types and associations, in order of their codes.
COVARIATE_TYPES = ("STRING", "FLOAT", "INTEGER")
STUDY_LEVEL, SAMPLE_LEVEL = 0, 1
RESPONSE_TYPES = ("abundance", "activity", "production")
#: Columns that a point table and a dataset table must have.
POINT_COLUMNS = ("Latitude", "Longitude", "Year")
DATASET_COLUMNS = ("Dataset ID", "Band Name", "Spatiotemporal Aggregation Function", "Pixel Value Transform")
