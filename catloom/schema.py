"""The one product schema that every reader ends in."""

PRODUCT = """platform string, site string, position int, url string, name string, clean_name string,
 price decimal(18,2), price_original decimal(18,2), price_raw string, currency string, brand string, sku string,
 ean string, category string, subcategory string, category_path array<string>, images array<string>,
 description string, available boolean, stock_status string, stock_qty int, specs map<string,string>,
 source string, http_status int, attempts int, elapsed_s double, bytes bigint, extracted_at timestamp, error string"""
