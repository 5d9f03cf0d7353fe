"""Public example numbers of identifiers, valid ones: fixed values."""

VALID = {
    "iban": "GB82 WEST 1234 5698 7654 32", "isbn": "978-0-306-40615-7", "issn": "0378-5955", "ean": "4006381333931", "imei": "49-015420-323751-8", "isin": "US0378331005", "cusip": "037833100", "lei": "5493001KJTIIGC8Y1R12",
    "es_dni": "54362315-K", "es_nie": "X-2482300W", "es_cif": "J99216582", "de_vat": "DE136695976", "de_idnr": "36 574 261 809", "br_cpf": "390.533.447-05", "br_cnpj": "16.727.230/0001-97", "nl_bsn": "111222333", "pl_pesel": "44051401359",
    "pl_nip": "8567346215", "ch_ssn": "756.9217.0769.85", "in_aadhaar": "2341 2341 2346", "au_abn": "51 824 753 556", "casrn": "87-86-5", "gb_nhs": "943 476 5870", "fr_siren": "552008443", "hr_oib": "33392005961", "be_vat": "BE 0428759497",
    "cl_rut": "76086428-5", "fi_hetu": "131052-308T", "it_iva": "IT 00743110157", "imo": "IMO 9319466", "pt_nif": "PT 501 964 843", "dk_cvr": "DK 13585628", "no_orgnr": "988 077 917", "gb_sedol": "B15KXQ8", "au_acn": "004 085 616",
}
