"""Schemas of the engine's tables, declared and never inferred."""

LISTING = (
    "source string, source_id string, url string, title string, type string, price bigint, area double, price_per_m2 double, rooms int, plot_area double, floor string, locality string, "
    "district string, street string, is_private boolean, market string, agency string, image string, created string, archived boolean"
)
OBSERVATION = "record_id bigint, obs_seq bigint, date date, price bigint, url string, source string, status string"
OVERRIDE = "url string, street string, nr string, locality string, rooms int, floor int, plot_area double, area double, dzialka_id string, x double, y double"
HASH_CACHE = "url string, hashes array<string>, seen date, urls array<string>"
FETCH = "url string, status int, final_url string, redirected boolean, body string"
FLAT_DEED = "dok_data string, tran_rodzaj_rynku string, tran_rodzaj_trans string, tran_cena_brutto string, lok_cena_brutto string, lok_pow_uzyt string, lok_liczba_izb string, lok_nr_kond string, lok_adres string, lok_funkcja string, lok_id_lokalu string"
HOUSE_DEED = "dok_data string, tran_rodzaj_rynku string, tran_rodzaj_trans string, tran_cena_brutto string, bud_cena_brutto string, bud_pow_uzyt string, bud_adres string, nier_pow_gruntu string, bud_id_budynku string"


def names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]
